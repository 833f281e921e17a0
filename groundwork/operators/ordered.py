"""What depends on order, without one task for a group: running sums, ranks and the last known value.

Rows are dealt by ranges of (group, order) and settled; a part's total of each of its groups, of
which there are few rows, is carried over to the later parts. So a group of any size is spread over
as many tasks as its rows ask for, and rows are moved twice whatever their groups' sizes.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.sources.shared import settled


def _free(rows: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in rows.columns}
    return [next(x for k in range(len(taken) + 1) if (x := "_" * k + n) not in taken) for n in names]


def _ranged(rows: DataFrame, by: Sequence[str], order: Sequence[str], part: str) -> DataFrame:
    """rows with the number of their range of (by, order), nulls first, written once so that it stays theirs."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(rows.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in (*by, *order))).withColumn(part, F.spark_partition_id()), "ranged")


def _meet(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """left with right's columns, by keys that may be null."""
    names = dict(zip(on, _free(left, *(f"met{k}" for k in range(len(on)))), strict=True))
    other = right.select(*(F.col(c).alias(names.get(c, c)) for c in right.columns))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(names[c])) for c in on))
    return left.join(other, same, "left").drop(*names.values())


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """rows with a column for each of `sums` (new name: what is summed), over the group's rows up to and with this one.

    A row's nulls count as nothing. Rows that no column of `order` tells apart stand in some order.
    """
    part, carried = _free(rows, "part", "carried")
    ranged = _ranged(rows, by, order, part)
    totals = ranged.groupBy(part, *by).agg(*(F.sum(c).alias(name) for name, c in sums.items()))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *by, F.struct(*(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums)).alias(carried))
    here = Window.partitionBy(part, *by).orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = _meet(ranged, offsets, [part, *by])
    return met.select(*rows.columns, *((F.col(carried)[n] + F.coalesce(F.sum(c).over(here), F.lit(0))).alias(n) for n, c in sums.items()))


def last_known(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, to: str) -> DataFrame:
    """rows with `to`: the last value, up to and with this row of its group, that is not null."""
    part, carried = _free(rows, "part", "carried")
    ranged = _ranged(rows, by, order, part)
    held = ranged.where(F.col(value).isNotNull())
    tails = held.groupBy(part, *by).agg(F.max_by(value, F.struct(*order)).alias(carried))
    # A part without a value of the group hands on what it got, which the earlier tails have too.
    groups = ranged.select(part, *by).distinct()
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = _meet(groups, tails, [part, *by]).withColumn(carried, F.last(carried, ignorenulls=True).over(before))
    here = Window.partitionBy(part, *by).orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = _meet(ranged, heads, [part, *by])
    return met.select(*rows.columns, F.coalesce(F.last(value, ignorenulls=True).over(here), F.col(carried)).alias(to))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, to: str) -> DataFrame:
    """left with `to`, the struct of right's row with the same `by` and the latest `right_at` up to `left_at`; null if there is none.

    Of right's rows of one time the largest, column by column, counts; its rows without a time, and
    left's, meet nothing. Both sides are put into one order, so no row of one meets every earlier row of the other.
    """
    at, side, payload, own, key = _free(left, "at", "side", "payload", "own", "key")
    keys = [f"{key}{k}" for k in range(len(by))]
    shared = lambda df: [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    kind = f"struct<{', '.join(f'`{c}`: {t}' for c, t in right.dtypes)}>"
    a = left.select(*shared(left), F.col(left_at).alias(at), F.lit(1).alias(side), F.lit(None).cast(kind).alias(payload), F.struct(*left.columns).alias(own))
    own_kind = dict(a.dtypes)[own]
    b = right.where(F.col(right_at).isNotNull()).select(*shared(right), F.col(right_at).alias(at), F.lit(0).alias(side), F.struct(*right.columns).alias(payload), F.lit(None).cast(own_kind).alias(own))
    found = last_known(a.unionByName(b), keys, [at, side, payload], payload, to).where(F.col(side) == 1)
    return found.select(*(F.col(own)[c].alias(c) for c in left.columns), F.when(F.col(at).isNotNull(), F.col(to)).alias(to))


def ranks_of(rows: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, a column for each share): the value at place int(n * share) of each group's sorted values; nulls do not count.

    Equal values are counted before anything is put in order.
    """
    n, upto = _free(rows, "n", "upto")
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias(n))
    sums = running_sums(counts, by, [value], {upto: n})
    whole = counts.groupBy(*by).agg(F.sum(n).alias(f"{n}_all"))
    met = _meet(sums, whole, list(by)) if by else sums.join(whole)
    place = lambda s: F.floor(F.col(f"{n}_all") * s)
    at = lambda s: F.max(F.when((place(s) >= F.col(upto) - F.col(n)) & (place(s) < F.col(upto)), F.col(value)))
    return met.groupBy(*by).agg(F.first(f"{n}_all").alias("n"), *(at(s).alias(name) for name, s in shares.items()))
