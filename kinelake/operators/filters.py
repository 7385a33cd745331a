"""Filters on episodes, frames and work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators.scans import highest, segmented_scan


def successful(path: Column) -> Column:
    return F.coalesce(path.rlike("success"), F.lit(False))


def in_ranges(frames: DataFrame, ranges: DataFrame | None, *, key: str = "episode", t: str = "t", range_rows: int | None = None) -> DataFrame:
    """Frames in a half-open range of their key; all without a table of ranges.

    A sweep over frames and ranges together, in the order of (key, t): a frame is
    inside if any range that has begun ends later, and of those the scan carries
    the latest end. So no frame meets a range as a pair, and a key with many of
    both costs no more than others. Frames without key or time, and ranges
    without key or bound, match nothing; overlapping ranges give a frame once.
    """
    if ranges is None:
        return frames
    own = frames.columns
    starts = ranges.filter(F.col(key).isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()).select(F.col(key).alias("__key"), F.col("start").alias("__t"), F.lit(0).alias("__kind"), F.col("end").alias("__end"))
    rows = frames.filter(F.col(key).isNotNull() & F.col(t).isNotNull()).withColumns({"__key": F.col(key), "__t": F.col(t), "__kind": F.lit(1)})
    both = rows.unionByName(starts, allowMissingColumns=True)
    swept = segmented_scan(both, ["__key"], ["__t", "__kind"], {"__reach": highest("__end")}, range_rows)
    return swept.filter((F.col("__kind") == 1) & (F.col("__reach") > F.col("__t"))).select(*own)


def until_failure(frames: DataFrame, ok: str, *, episode: str = "episode", t: str = "t") -> DataFrame:
    """Frames before an episode's first that isn't ``ok``."""
    w = Window.partitionBy(episode).orderBy(t)
    return frames.withColumn("__ok", F.min(F.col(ok).cast("int")).over(w)).filter("__ok = 1").drop("__ok")


def moving(frames: DataFrame, flag: str, remove_skipped: bool = False) -> DataFrame:
    """Without frames whose flag is false (missing: true), if asked for."""
    return frames.filter(F.coalesce(F.col(flag), F.lit(True))) if remove_skipped else frames


def not_done(items: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    return items.join(done.select(key).distinct(), key, "left_anti")


def not_done_in_all(items: DataFrame, done: DataFrame, blocks: int, *, key: str = "key", block: str = "block") -> DataFrame:
    """Items that at least one of ``blocks`` blocks lacks."""
    whole = done.groupBy(key).agg(F.count_distinct(block).alias("n")).filter(F.col("n") >= blocks)
    return items.join(whole.select(key), key, "left_anti")


def clamped(start: Column, end: Column, total: Column) -> tuple[Column, Column]:
    """An interval inside [0, total); an end of -1 means the whole."""
    zero = F.lit(0)
    return F.greatest(zero, F.least(start, total)), F.when(end == -1, total).otherwise(F.greatest(zero, F.least(end, total)))


def latest_number(names: Column) -> Column:
    """Aggregate: the largest of the names that are numbers."""
    return F.max(F.when(names.rlike("^[0-9]+$"), names.cast("long")))


def path_matches(path: Column, pattern: str) -> Column:
    """Whether the whole path matches."""
    return path.rlike(f"^(?:{pattern})$")


def by_kind(cameras: Column, wrist: bool) -> Column:
    """Of a map from camera to type, the wrist cameras (type 0) or the others."""
    return F.map_filter(cameras, lambda _, kind: kind == 0 if wrist else kind != 0)
