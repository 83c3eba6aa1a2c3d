"""Nested values: lookups by path, numbers that JSON can hold, usage fields under several names, times and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dig(document: Column, path: str, kind: str = "double") -> Column:
    """The value at ``a/b/c`` in a VARIANT, or null where a step is missing or it is of another kind."""
    return F.try_variant_get(document, "$" + "".join(f"['{step}']" for step in path.split("/")), kind)


def dig_many(long: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """Every wanted path of every document (key, path, value), null where the document lacks it."""
    wanted = long.select(key).distinct().crossJoin(F.broadcast(paths.select("path")))  # paths are named by hand
    return wanted.join(long, [key, "path"], "left")


def json_safe(value: Column) -> Column:
    """A number as JSON can hold it: NaN and infinities become null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def json_safe_columns(df: DataFrame) -> DataFrame:
    """All floating columns of a table, made safe, for a JSON sink."""
    return df.select(*[json_safe(F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


def usage(response: Column) -> Column:
    """struct<prompt_tokens, completion_tokens, cost, reasoning_tokens, cached_tokens, provider> from where replies may hold them."""

    def first(kind: str, *paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(response, f"$.{p}", kind) for p in paths])

    return F.struct(
        first("long", "usage.prompt_tokens", "usage.input_tokens").alias("prompt_tokens"), first("long", "usage.completion_tokens", "usage.output_tokens").alias("completion_tokens"),
        first("double", "usage.cost", "usage.model_extra.cost").alias("cost"),
        first("long", "usage.completion_tokens_details.reasoning_tokens", "usage.model_extra.reasoning_tokens").alias("reasoning_tokens"),
        first("long", "usage.prompt_tokens_details.cached_tokens", "usage.model_extra.cached_tokens").alias("cached_tokens"),
        first("string", "provider", "model_extra.provider").alias("provider"),
    )


def utc(text: Column) -> Column:
    """An ISO time with an offset as a timestamp, or null."""
    return F.try_to_timestamp(text)


def started(rows: DataFrame, time: str, by: list[str]) -> DataFrame:
    """The earliest of ISO times in UTC (they sort as text), and its date."""
    return rows.groupBy(*by).agg(F.min(time).alias("started")).withColumn("date", F.substring("started", 1, 10))


def percent(value: Column, places: int = 1) -> Column:
    """A share as a percentage; an em dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.concat(F.format_string(f"%.{places}f", value * 100), F.lit("%")))


def small(value: Column) -> Column:
    """A p-value for a digest: three places, or two significant ones below 0.001; an em dash for null."""
    return F.when(value.isNull(), "—").when(value < 0.001, F.format_string("%.2e", value)).otherwise(F.format_string("%.3f", value))


def briefs(rows: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """One row: a map from the name to its fields. The rows are a dimension that people write."""
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name), F.struct(*fields))))).alias("briefs"))


def shortened(struct_array: Column, limits: dict[str, int]) -> Column:
    """An array of structs with some text fields cut to a length."""

    def one(x: Column) -> Column:
        for field, n in limits.items():
            x = x.withField(field, F.left(x[field], F.lit(n)))
        return x

    return F.transform(struct_array, one)
