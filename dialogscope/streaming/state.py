"""Keyed state over streams: a flag that stays once it has held, and a budget that ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, DoubleType, IntegralType, LongType, StructField, StructType, TimestampNTZType, TimestampType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(stream: DataFrame, key: str, processor: StatefulProcessor, schema: StructType, mode: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, mode, "None")


def _as_long(stream: DataFrame, name: str) -> Column:
    kind = stream.schema[name].dataType
    if isinstance(kind, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(name) if isinstance(kind, TimestampType) else F.col(name).cast("long")


def _value(x, whole: bool):
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    if x is None or x is pd.NaT or isinstance(x, float) and x != x:
        return None
    if whole:  # pandas holds whole numbers among nulls as floats
        return int(x)
    return x.item() if hasattr(x, "item") else x


def _rows(batches: Iterator[pd.DataFrame], whole: list[bool]) -> list[tuple]:
    """Rows as tuples of Python values; NaN is a null."""
    return [tuple(map(_value, r, whole)) for batch in batches for r in batch.astype(object).itertuples(index=False, name=None)]


def _whole(schema: StructType) -> list[bool]:
    return [isinstance(f.dataType, IntegralType) for f in schema.fields]


class _Latch(StatefulProcessor):
    """Holds the place of the first flagged row, and the rows before it (or all, while there is none), which a late flag may still change."""

    def __init__(self, columns: list[str], rows: StructType, places: StructType):
        self.columns, self.rows, self.places, self.width, self.whole = columns, rows, places, len(places), [False, *_whole(rows)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", self.places)
        self.open = handle.getListState("open", self.rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r[1:] for r in _rows(rows, self.whole)]  # after the key: the flag, the places, then the row
        place = lambda r: tuple((x is not None, x or 0) for x in r[1 : 1 + self.width])  # noqa: E731  nulls first
        firsts = [place(r) for r in new if r[0]]
        before = None
        if self.first.exists():
            before = tuple((x is not None, x or 0) for x in self.first.get())
        first = min([*firsts, *([before] if before is not None else [])], default=None)
        late = firsts and before is not None and first < before  # rows given out as unflagged come again
        held = list(self.open.get()) if first is not None and first != before or late else []
        again = [tuple(r) for r in held if place(r) > first] if first is not None else []
        still = [tuple(r) for r in held if first is None or place(r) <= first]
        added = [r for r in new if first is None or place(r) <= first]
        if first is not None and first != before:
            self.first.update(tuple(x if there else None for there, x in first))
            self.open.put([*still, *added]) if still or added else self.open.clear()
        elif added:
            self.open.appendList(added)
        out = [(*r[1 + self.width :], first is not None and place(r) > first) for r in [*again, *new]]
        if out:
            yield pd.DataFrame(out, columns=self.columns, dtype=object)

    def close(self) -> None:
        pass


def latched(stream: DataFrame, key: str, order: str | list[str], flag: Column, name: str) -> DataFrame:
    """``sets.latched`` of a stream: adds whether the flag has held in an earlier row of the key.

    Rows may come in any order and in any micro-batches. A flagged row that comes late changes rows that were given out: they are
    given out again, so the sink must keep the last row for each key and place in ``order`` (``logs.upsert`` with ``changes``), in which a
    latch only ever turns from false to true. State of a key: the first flagged place, and the rows up to it. ``order``: whole numbers or
    timestamps, nulls first; rows without a key share one state. Rows of equal place don't latch each other.
    """
    order = [order] if isinstance(order, str) else list(order)
    places = {f"__place{i}": _as_long(stream, c) for i, c in enumerate(order)}
    given = stream.select("*", F.coalesce(flag, F.lit(False)).alias("__flag"), *[v.alias(k) for k, v in places.items()])
    given = given.select(key, "__flag", *places, *[F.col(c).alias(f"__own{i}") for i, c in enumerate(stream.columns)])
    out = StructType([*stream.schema.fields, StructField(name, BooleanType())])
    place_type = StructType([StructField(p, LongType()) for p in places])
    return _keyed(given, key, _Latch(out.names, StructType(given.schema.fields[1:]), place_type), out, "Update")


def spend_replay(stream: DataFrame, order: str, cost: str, cap: float, *, by: str, fail_closed: bool = False, stop: bool = False) -> DataFrame:
    """``sets.spend_replay`` of a stream: adds what was ``spent`` before each row, and whether it ``runs``.

    Rows of later micro-batches come after those of earlier ones; within one they go by ``order`` (nulls first). With ``stop`` rows that
    don't run aren't given out. As in batch, what doesn't run still counts as spent. Each ``by`` has its own budget; a missing cost
    counts as nothing and, with ``fail_closed``, ends the budget.
    """
    fields = [*stream.schema.fields, StructField("spent", DoubleType()), StructField("runs", BooleanType())]
    names, whole, at, paid = [f.name for f in fields], _whole(stream.schema), stream.columns.index(order), stream.columns.index(cost)

    def replay(key: tuple, frames: Iterator[pd.DataFrame], budget: GroupState) -> Iterator[pd.DataFrame]:
        spent, missing = budget.get if budget.exists else (0.0, False)
        out = []
        for r in sorted(_rows(frames, whole), key=lambda r: (r[at] is not None, r[at] or 0)):
            runs = spent < cap and not (fail_closed and missing)
            if runs or not stop:
                out.append((*r, spent, runs))
            spent, missing = spent + (r[paid] or 0.0), missing or r[paid] is None
        budget.update((float(spent), bool(missing)))
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    # the state travels with the rows: a call to the state's server for each key would cost more than its rows
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy(by).applyInPandasWithState(replay, StructType(fields), "spent double, missing boolean", "append", GroupStateTimeout.NoTimeout)
