"""Panels of three seats: who sits, how the votes combine, how far they agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seats_for(providers: Column, advisor: Column, rotation: Column, size: int = 3) -> Column:
    """The sorted providers but the advisor's own, without those that the rotation sets aside."""
    eligible = F.array_sort(F.array_remove(providers, advisor))
    n = F.size(eligible)
    aside = F.transform(F.sequence(F.lit(0), F.greatest(n - size - 1, F.lit(0))), lambda k: F.pmod(rotation + k, n))
    return F.when(n <= size, eligible).otherwise(F.filter(eligible, lambda x, i: ~F.array_contains(aside, i)))


def _judged(panel: Column) -> Column:
    return F.filter(panel, lambda s: s["status"] == "judged")


def combine(panel: Column, n: Column) -> Column:
    """struct<init, tod, irn, quote, median, aggregation, splits, failed> of a panel, or null.

    ``panel``: array of struct<judge, status, init, tod, irn, quote>, tod and irn null for "NA". Three
    judged seats: the majority on init, the middle ToD (no degradation counts as n + 1), the middle
    response number ("NA" as 3); the quote is the middle seat's if its ToD is the result and not
    beyond n. Two of three: the stricter of each, with the fields on which they differ, the quote of the first seat
    with the resulting ToD, and the seat that failed, whole. ``median`` names the seat that the ToD is from; a panel
    whose start is wrong has none. Anything else is no verdict.
    """
    ok = _judged(panel)
    failed = F.get(F.filter(panel, lambda s: ~F.coalesce(s["status"] == "judged", F.lit(False))), F.lit(0))
    coded = F.transform(ok, lambda s: F.when((s["init"] == 1) & (s["tod"] <= n), s["tod"]).otherwise(n + 1))
    order = F.array_sort(F.transform(ok, lambda s, i: F.struct(F.get(coded, i).alias("tod"), i.alias("seat"))))
    irn = F.array_sort(F.transform(ok, lambda s: F.coalesce(s["irn"], F.lit(3))))
    ones = F.aggregate(ok, F.lit(0), lambda a, s: a + s["init"])
    middle = F.get(order, F.lit(1))
    seat = F.get(ok, middle["seat"])
    init3 = F.when(ones >= 2, 1).otherwise(0)
    tod3 = F.when(init3 == 1, middle["tod"])
    three = F.struct(
        init3.alias("init"),
        tod3.alias("tod"),
        F.when(F.get(irn, F.lit(1)) < 3, F.get(irn, F.lit(1))).alias("irn"),
        F.when((init3 == 1) & (seat["init"] == 1) & (seat["tod"] == tod3) & (tod3 <= n), seat["quote"]).otherwise("").alias("quote"),
        F.when(init3 == 1, seat["judge"]).alias("median"),
        F.lit("median").alias("aggregation"),
        F.array().cast("array<string>").alias("splits"),
        F.when(F.lit(False), failed).alias("failed"),
    )
    first = F.get(ok, F.get(order, F.lit(0))["seat"])
    differ = lambda name, values: F.when(F.size(F.array_distinct(values)) > 1, F.lit(name))
    init2 = F.when(ones == 2, 1).otherwise(0)
    tod2 = F.when(init2 == 1, F.array_min(coded))
    splits = F.array_compact(F.array(differ("init_correct", F.transform(ok, lambda s: s["init"])), differ("ToD", coded), differ("init_response_number", irn)))
    two = F.struct(
        init2.alias("init"),
        tod2.alias("tod"),
        F.when(F.get(irn, F.lit(0)) < 3, F.get(irn, F.lit(0))).alias("irn"),
        F.when((init2 == 1) & (tod2 <= n) & (first["tod"] == tod2), F.coalesce(first["quote"], F.lit(""))).otherwise("").alias("quote"),
        F.when(init2 == 1, first["judge"]).alias("median"),
        F.lit("two_seat_fallback").alias("aggregation"),
        splits.alias("splits"),
        failed.alias("failed"),
    )
    return F.when((F.size(panel) == 3) & (F.size(ok) == 3), three).when((F.size(panel) == 3) & (F.size(ok) == 2), two)


def agreement(panel: Column) -> Column:
    """struct<init_unanimous, tod_votes, tod_unanimous, spread>; ToD only with two votes or more."""
    ok = _judged(panel)
    inits = F.array_distinct(F.transform(ok, lambda s: s["init"]))
    tods = F.array_compact(F.transform(F.filter(ok, lambda s: s["init"] == 1), lambda s: s["tod"]))
    several = F.size(tods) >= 2
    return F.struct(
        (F.size(inits) == 1).alias("init_unanimous"),
        F.size(tods).alias("tod_votes"),
        F.when(several, F.size(F.array_distinct(tods)) == 1).alias("tod_unanimous"),
        F.when(several, F.array_max(tods) - F.array_min(tods)).alias("spread"),
    )


def verdict_error(init: Column, irn: Column, tod: Column, quote: Column, n: Column) -> Column:
    """The first rule that a verdict breaks, or null. ``irn`` and ``tod`` are null for "NA"."""
    return (
        F.when(init.isNull() | ~init.isin(0, 1), "init_correct")
        .when((init == 0) & tod.isNotNull(), "ToD without a correct start")
        .when((init == 0) & (quote != ""), "quote without a correct start")
        .when((init == 1) & (irn.isNull() | ~irn.isin(1, 2)), "init_response_number")
        .when((init == 1) & (tod.isNull() | ~tod.between(2, n + 1)), "ToD out of range")
        .when((init == 1) & (tod <= irn), "ToD not after the start")
        .when((init == 1) & ((tod == n + 1) != (quote == "")), "quote against ToD")
    )
