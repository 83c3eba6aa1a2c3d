"""Looking up run names: exact, by the name without its date, or the names that come nearest."""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialogscope.sources.records import run_id_error

NEAREST = 5
CUTOFF = 0.4


def near_names(known: DataFrame, name: str, asked: list[str], *, n: int = NEAREST, cutoff: float = CUTOFF) -> DataFrame:
    """(asked, name, ratio, rank): for each of ``asked`` the ``n`` distinct names most like it, of those with a ratio of ``cutoff`` or more.

    The ratio is difflib's, ties go to the greater name. What is asked for comes from a person and travels to the tasks; each task compares its
    names (lengths and letters bound the ratio from above first) and hands on its best ``n``. Null names take no part.
    """
    asked = sorted(set(asked))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict[str, list[tuple[float, str]]] = {a: [] for a in asked}
        matchers = [difflib.SequenceMatcher(b=a) for a in asked]
        for batch in batches:
            for x in batch["name"]:
                for a, m in zip(asked, matchers, strict=True):
                    m.set_seq1(x)
                    if m.real_quick_ratio() >= cutoff and m.quick_ratio() >= cutoff and (r := m.ratio()) >= cutoff:
                        heap = top[a]
                        (heapq.heappush if len(heap) < n else heapq.heappushpop)(heap, (r, x))
        yield pd.DataFrame([(a, x, r) for a, heap in top.items() for r, x in heap], columns=["asked", "name", "ratio"])

    found = known.select(F.col(name).alias("name")).where("name is not null").distinct().mapInPandas(best, "asked string, name string, ratio double")
    along = Window.partitionBy("asked").orderBy(F.desc("ratio"), F.desc("name"))
    return found.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= n)


def require_run(runs: DataFrame, run_id: str, *, n: int = NEAREST) -> str:
    """The run id if ``runs`` (column run) holds it; otherwise an error that names the nearest ones, or the first ones if none is near."""
    spark = runs.sparkSession
    bad = spark.range(1).select(run_id_error(F.lit(run_id))).first()[0]
    if bad:
        raise ValueError(f"{run_id!r} is no run id: {bad}")
    if not runs.where(F.col("run") == run_id).isEmpty():
        return run_id
    near = [r["name"] for r in near_names(runs, "run", [run_id], n=n).orderBy("rank").collect()]
    near = near or [r["run"] for r in runs.select("run").distinct().orderBy("run").limit(n).collect()]
    raise LookupError(f"no run {run_id!r}; " + (f"did you mean: {', '.join(near)}" if near else "there are no runs"))


def study_for_name(studies: DataFrame, name: str, today: str) -> str:
    """The one study (column run) of that name whatever its date, a new id of today if there is none; several are an error."""
    found = sorted(r[0] for r in studies.where(F.get(F.split("run", "__"), F.lit(1)) == name).select("run").distinct().limit(NEAREST + 1).collect())
    if len(found) > 1:
        raise LookupError(f"studies that share the name {name!r}: {', '.join(found)}")
    return found[0] if found else f"{today}__{name}"


# Short labels of families, where a reader sees one.
SHORT = {"transport_ambulance_cost": "transport", "cost_medical_debt": "cost", "hospital_fear": "fear"}


def short_family(family: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in SHORT.items() for x in pair])[family], family)


def display_ids(records: DataFrame, slugs: DataFrame, key: str = "conversation_id") -> DataFrame:
    """Adds ``display``: the id with the vignette's slug and the family's short label; a vignette without a slug (id, slug) keeps its number, null stays null."""
    named = slugs.groupBy(F.col("id").alias("__id")).agg(F.max("slug").alias("__slug"))
    p = F.col("__parts")
    shown = F.transform(p, lambda x, i: F.when(i == 0, F.coalesce("__slug", x)).when(i == 1, short_family(x)).otherwise(x))
    marked = records.withColumn("__parts", F.split(key, "__"))
    return marked.join(named, p[0] == F.col("__id"), "left").withColumn("display", F.array_join(shown, "__")).drop("__parts", "__id", "__slug")


def resolvable(shown: DataFrame, records: DataFrame, slugs: DataFrame, display: str = "display", key: str = "conversation_id") -> DataFrame:
    """The distinct ``display`` ids of four parts that name a record: its vignette by the slug, its family by the short label, and its last two parts."""
    p, r = F.split(display, "__"), F.split(key, "__")
    parts = lambda a, b, c, d: (a.alias("__v"), b.alias("__f"), c.alias("__a"), d.alias("__r"))
    known = records.where(F.size(r) >= 3).select(*parts(r[0], short_family(r[1]), F.element_at(r, -2), F.element_at(r, -1)))
    asked = shown.where(F.size(p) == 4).select(display, p[0].alias("slug"), *parts(F.lit(None), p[1], p[2], p[3])[1:]).distinct()
    return asked.join(slugs.select("slug", F.col("id").alias("__v")), "slug").join(known, ["__v", "__f", "__a", "__r"], "left_semi").select(display).distinct()
