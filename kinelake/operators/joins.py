"""Look-ups as joins. Small sides are left to Spark, which knows their size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prompts(frames: DataFrame, tasks: DataFrame, *, task: str = "task_index", prompt: str = "prompt") -> DataFrame:
    """The prompt of each frame's task; a task that isn't known is an error."""
    t = tasks.select(F.col(task).alias("__task"), F.col(prompt).alias("__prompt"))
    known = frames.join(t, F.col(task) == F.col("__task"), "left")
    missing = F.raise_error(F.concat(F.lit("no prompt for task "), F.coalesce(F.col(task).cast("string"), F.lit("null"))))
    return known.withColumn(prompt, F.when(F.col("__task").isNull(), missing.cast("string")).otherwise(F.col("__prompt"))).drop("__task", "__prompt")


def with_default(left: DataFrame, right: DataFrame, key: str, value: str, default: str) -> DataFrame:
    return left.join(right.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def cached(frames: DataFrame, cache: DataFrame, key: str = "index") -> DataFrame:
    """Frames with the cache's columns; those it lacks stay as they are (nulls)."""
    return frames.join(cache, key, "left")


def used_tasks(tasks: DataFrame, episodes: DataFrame, *, task: str = "task") -> DataFrame:
    """The tasks that any of the episodes names, with their own numbers."""
    used = episodes.select(F.explode("tasks").alias(task)).distinct()
    return tasks.join(used, task, "left_semi")


def categories(tasks: DataFrame, names: DataFrame) -> DataFrame:
    """``task_id`` (from 0) with category and name by the 1-based ``id``; unknown ones get ``unknown`` and ``task_<id>``."""
    n = names.select((F.col("id") - 1).alias("task_id"), "category", "name")
    return tasks.join(n, "task_id", "left").withColumns({"category": F.coalesce("category", F.lit("unknown")), "name": F.coalesce("name", F.concat(F.lit("task_"), F.col("task_id").cast("string")))})


def merge_parameters(loaded: DataFrame, reference: DataFrame, missing: str) -> DataFrame:
    """Loaded values of the keys that the reference has, in its type, and its own for missing keys that match a pattern."""
    kind = reference.schema["value"].dataType
    both = loaded.join(reference.select("key"), "key", "left_semi").select("key", F.col("value").cast(kind).alias("value"))
    rest = reference.join(loaded.select("key"), "key", "left_anti").filter(F.col("key").rlike(f"^(?:{missing})$"))
    return both.unionByName(rest.select("key", "value"))


def nearest(targets: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """For each (key, target), the value nearest to it; of equals the one at the first position.

    Targets and values are sorted together once a key: only the last value up to
    a target and the next one can be nearest.
    """
    v = values.filter("value IS NOT NULL").groupBy(key, "value").agg(F.min("position").alias("position"))
    v = v.select(key, F.col("value").cast("double").alias("__at"), F.lit(True).alias("__is_value"), F.struct("value", "position").alias("__v"))
    t = targets.select(key, "target").distinct().select(key, F.col("target").cast("double").alias("__at"), F.lit(False).alias("__is_value"), "target")
    both = v.unionByName(t, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("__at", F.desc("__is_value"))
    low = F.last("__v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("__v", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    near = both.withColumns({"__low": low, "__high": high}).filter("NOT __is_value")
    ranked = F.array_sort(F.filter(F.array(*(F.struct(F.abs(F.col(c)["value"] - F.col("target")).alias("d"), F.col(c)["position"].alias("p"), F.col(c)["value"].alias("value")) for c in ("__low", "__high"))), lambda x: x["value"].isNotNull()))
    return near.filter(F.size(ranked) > 0).select(key, "target", ranked[0]["value"].alias("nearest"))


def once_each(df: DataFrame, text: str, compute) -> DataFrame:
    """``compute`` (a frame of distinct texts to a frame with more columns) once a text, then back to all rows."""
    return df.join(compute(df.select(text).distinct()), text)


def time_offset(frames: DataFrame, k: int, value: str, *, episode: str = "episode", t: str = "t", out: str = "ahead") -> DataFrame:
    """The value of frame ``t + k``; null if there is none."""
    w = Window.partitionBy(episode).orderBy(t).rangeBetween(k, k)
    return frames.withColumn(out, F.first(value).over(w))


def at_times(frames: DataFrame, offsets: Sequence[float], value: str, *, ts: str = "ts", tolerance: float = 1e-4, tie: str, episode: str = "episode", out: str = "values") -> DataFrame:
    """For each frame and each of ``offsets`` (seconds), what its episode has at that time: an array of ``value, pad``.

    The frame nearest to the wanted time counts, if it is within ``tolerance``
    seconds; of equally near ones the earlier, and of equal stamps the least
    ``tie``. Times before the first and after the last frame give that one, with
    ``pad``; where frames were dropped and none is near, the value is null. A
    window looks at the frames around the wanted time only, and all offsets share
    one shuffle by episode. ``ts``: seconds, or a time stamp.
    """
    kind = frames.schema[ts].dataType.simpleString()
    micros = F.unix_micros(F.col(ts).cast("timestamp")) if kind.startswith("timestamp") else F.round(F.col(ts) * 1_000_000).cast("long")
    frame = lambda us: F.struct(us.alias("us"), F.col(tie).alias("tie"), F.col(value).alias("value"))
    rows = frames.withColumn("__us", micros).withColumns({"__up": frame(F.col("__us")), "__down": frame(-F.col("__us"))})
    whole = Window.partitionBy(episode)
    rows = rows.withColumns({"__first": F.min("__up").over(whole), "__last": F.min("__down").over(whole)})
    by_time, near = whole.orderBy("__us"), round(tolerance * 1_000_000)
    shifts = [round(x * 1_000_000) for x in offsets]
    rows = rows.withColumns({f"__{side}{i}": F.min(c).over(by_time.rangeBetween(a, b)) for i, us in enumerate(shifts) for side, c, a, b in (("before", "__down", us - near, us), ("after", "__up", us, us + near))})

    def pick(i: int, us: int) -> Column:
        before, after, target = F.col(f"__before{i}"), F.col(f"__after{i}"), F.col("__us") + us
        nearest = F.when(after.isNull() | (target + before["us"] <= after["us"] - target), before["value"]).otherwise(after["value"])  # ``us`` is negative in ``before``
        early, late = target < F.col("__first.us") - near, target > -F.col("__last.us") + near
        return F.struct(F.when(early, F.col("__first.value")).when(late, F.col("__last.value")).otherwise(nearest).alias("value"), (early | late).alias("pad"))

    return rows.withColumn(out, F.array(*(pick(i, us) for i, us in enumerate(shifts)))).select(*frames.columns, out)
