"""Half-open whole-number intervals by group, and sets of work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinelake.operators.scans import highest, last, segmented_scan


def merge(intervals: DataFrame, group: str, range_rows: int | None = None) -> DataFrame:
    """Overlapping and touching intervals become one.

    An interval that starts beyond the ends of all before it begins a new one,
    which ends where they all did when the next begins. Two scans, so a group may
    have any number of intervals.
    """
    parts = segmented_scan(intervals.select(group, "start", "end"), [group], ["start", "end"], {"__before": highest("end")}, range_rows)
    begun = parts.filter(F.coalesce(F.col("start") > F.col("__before"), F.lit(True))).select(group, "start", F.col("__before").alias("__ended"))
    begun = segmented_scan(begun, [group], [F.desc("start")], {"end": last("__ended")}, range_rows).drop("__ended")
    # The last of each group, a row a group, ends where the group does.
    ends = intervals.groupBy(F.col(group).alias("__group")).agg(F.max("end").alias("__end"))
    finals = begun.filter("end IS NULL").join(ends, F.col(group).eqNullSafe(F.col("__group"))).select(group, "start", F.col("__end").alias("end"))
    return begun.filter("end IS NOT NULL").unionByName(finals)


def complement(merged: DataFrame, totals: DataFrame, group: str, range_rows: int | None = None) -> DataFrame:
    """What merged intervals leave of [0, ``total``); a group without any lacks all.

    A gap ends where the next interval starts, or with the group, whose total
    is a mark of its own in the scan, so that nothing is joined.
    """
    zero = F.lit(0).cast("long")
    gaps = merged.select(group, "start", "end").unionByName(totals.select(group, zero.alias("start"), zero.alias("end")))
    marks = gaps.withColumn("total", F.lit(None).cast("long")).unionByName(totals.select(group, F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.col("total").cast("long").alias("total")))
    at = F.desc_nulls_first("start"), F.desc_nulls_first("end")  # from the group's end: its total, then its intervals
    out = segmented_scan(marks, [group], at, {"next": last("start"), "whole": last("total")}, range_rows)
    ends = out.filter("end IS NOT NULL AND whole IS NOT NULL").select(group, F.col("end").alias("start"), F.least(F.coalesce("next", "whole"), F.col("whole")).alias("end"))
    return ends.filter(F.col("start") < F.col("end"))


def coverage(merged: DataFrame, totals: DataFrame, group: str) -> DataFrame:
    covered = merged.groupBy(group).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return totals.join(covered, group, "left").withColumn("covered", F.coalesce("covered", F.lit(0))).withColumn("missing", F.col("total") - F.col("covered"))


def split(intervals: DataFrame, size: int) -> DataFrame:
    """Pieces of at most ``size``; the last of each may be shorter."""
    some = intervals.filter(F.col("start") < F.col("end"))
    at = some.withColumn("__at", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(size).cast("long"))))
    return at.withColumns({"start": F.col("__at"), "end": F.least(F.col("__at") + size, F.col("end"))}).drop("__at")


def parse_names(names: Column) -> Column:
    """``struct<start, end>`` of names like ``100_200.json``; null for others."""
    pattern = r"^(\d+)_(\d+)\.json$"
    part = lambda i: F.regexp_extract(names, pattern, i).cast("long")
    return F.when(names.rlike(pattern), F.struct(part(1).alias("start"), part(2).alias("end")))


def parse_shard_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """``suite, start, end`` of lines with three fields; comments and blank lines don't count, others are errors."""
    text = F.trim(F.regexp_replace(F.col(column), r"#.*$", ""))
    fields = lines.withColumn("__text", text).filter("__text != ''").withColumn("__f", F.split("__text", r"\s+"))
    bad = F.raise_error(F.concat(F.lit("bad line: "), F.col(column))).cast("string")
    f = lambda i: F.when(F.size("__f") == 3, F.col("__f")[i]).otherwise(bad)
    return fields.select(f(0).alias("suite"), f(1).cast("long").alias("start"), f(2).cast("long").alias("end"))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    for df in others:
        first = first.unionByName(df)
    return first


def done_in_every(done: Sequence[DataFrame], key: str) -> DataFrame:
    out = done[0].select(key)
    for d in done[1:]:
        out = out.intersect(d.select(key))
    return out.distinct()


def block_indices(wanted: Column, blocks: int) -> Column:
    """Distinct block numbers in order; negative ones count from the end; others out of range are errors."""
    at = F.transform(wanted, lambda b: F.when(b < 0, b + blocks).otherwise(b))
    bad = F.exists(at, lambda b: (b < 0) | (b >= blocks))
    return F.when(bad, F.raise_error(F.lit(f"block index out of range [0, {blocks})")).cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(at)).cast("array<bigint>"))


def every_kth_block(interval: int, blocks: int) -> list[int]:
    return list(range(interval - 1, blocks, interval))
