"""Scans of a sorted table that carry something from row to row and start anew with each group.

A group may hold most of the rows: it is parted into ranges, each range is
scanned by itself, and what it comes to goes to the ranges after it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators import aggregates
from kinelake.sources.shared import staged


@dataclass(frozen=True)
class Carry:
    """What a scan carries of the column ``value``; null where nothing has come.

    ``fold`` makes a window's column of it, ``whole`` an aggregate (of the column
    and the place of each row), ``join`` one result of an earlier and a later one;
    a fold of wholes must be the whole. ``after``: with the current row, not just
    the rows before it.
    """

    value: str
    fold: Callable[[Column], Column]
    whole: Callable[[Column, Column], Column]
    join: Callable[[Column, Column], Column]
    after: bool = False


def total(value: str, after: bool = False) -> Carry:
    return Carry(value, F.sum, lambda v, _: F.sum(v), lambda a, b: F.coalesce(a + b, a, b), after)


def highest(value: str, after: bool = False) -> Carry:
    return Carry(value, F.max, lambda v, _: F.max(v), F.greatest, after)


def lowest(value: str, after: bool = False) -> Carry:
    return Carry(value, F.min, lambda v, _: F.min(v), F.least, after)


def last(value: str, after: bool = False) -> Carry:
    """The last value that isn't null."""
    return Carry(value, lambda c: F.last(c, ignorenulls=True), lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)), lambda a, b: F.coalesce(b, a), after)


def first(value: str, after: bool = False) -> Carry:
    """The first value that isn't null, as where a flag was first true."""
    return Carry(value, lambda c: F.first(c, ignorenulls=True), lambda v, at: F.min_by(v, F.when(v.isNotNull(), at)), F.coalesce, after)


def segmented_scan(rows: DataFrame, group: Sequence[str], order: Sequence[str | Column], carries: Mapping[str, Carry], range_rows: int | None = None) -> DataFrame:
    """``rows`` with a column for each of ``carries``, over the rows of the same group in that order.

    Null is a group like others. Rows that tie in ``order`` come in the order of a
    hash of their columns, so reruns agree. Where no group has more than
    ``range_rows`` rows, a window by group does. Else the rows are dealt out by
    ranges of (group, order) of about so many, each range is scanned by itself, and
    the first group of a range, the only one that others may have begun, goes on
    from what those have come to: a row a range. The rows are staged first, so
    they are computed once; an empty table gives an empty one.
    """
    range_rows = range_rows or aggregates.RANGE_ROWS
    rows = staged(rows, "rows")
    most = rows.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    plain = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    by = [*(F.asc(c) if isinstance(c, str) else c for c in order), F.xxhash64(*plain).asc()]
    known = F.struct(*group) if group else F.struct(F.lit(0).alias("one"))

    def scanned(df: DataFrame, segment: Sequence[str], places: Sequence[Column]) -> DataFrame:
        w = Window.partitionBy(*segment).orderBy(*places)
        return df.withColumns({out: c.fold(F.col(c.value)).over(w.rowsBetween(Window.unboundedPreceding, 0 if c.after else -1)) for out, c in carries.items()})

    if most <= range_rows:
        return scanned(rows, group or [F.lit(0)], by)
    n = max(2, min(aggregates.MOST_RANGES, -(-rows.count() // range_rows)))
    keys = [*map(F.asc, group), *by]
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = staged(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "ranges")
    named = dealt.withColumn("__group", known)
    # What each range's last group has come to goes to the ranges after it that begin with the same group.
    ends = named.groupBy("__part", "__group").agg(F.max("__at").alias("__at"), *(c.whole(F.col(c.value), F.col("__at")).alias(out) for out, c in carries.items()))
    ends = ends.groupBy("__part").agg(F.max_by(F.struct("__group", *carries), "__at").alias("end"), F.min_by("__group", "__at").alias("begin"))
    given = ends.select(F.col("end.__group").alias("__group"), "__part", F.lit(1).alias("__kind"), *(F.col(f"end.{out}").alias(out) for out in carries))
    asked = ends.select(F.col("begin").alias("__group"), "__part", F.lit(0).alias("__kind"))
    before = Window.partitionBy("__group").orderBy("__part", "__kind").rowsBetween(Window.unboundedPreceding, -1)
    folded = given.unionByName(asked, allowMissingColumns=True).withColumns({f"__in_{out}": c.fold(F.col(out)).over(before) for out, c in carries.items()})
    carried = folded.filter("__kind = 0").select(F.col("__part").alias("__to"), F.col("__group").alias("__of"), *(f"__in_{out}" for out in carries))
    joined = scanned(named, ["__part", *group], ["__at"]).join(F.broadcast(carried), (F.col("__part") == F.col("__to")) & F.col("__group").eqNullSafe(F.col("__of")), "left")  # MOST_RANGES rows at most
    return joined.withColumns({out: c.join(F.col(f"__in_{out}"), F.col(out)) for out, c in carries.items()}).select(*rows.columns, *carries)
