"""Statistics and roll-ups.

Statistics of vectors are taken as ``(key, dim, value)`` rows: partial
aggregation leaves one row a dimension and task, whatever the data's size.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.sources.shared import staged

#: The bins of a histogram and what they reach beyond the range.
BINS, PADDING = 5000, 1e-10
#: The order in which categories are shown; others follow by name.
CATEGORY_ORDER = ("Camera Viewpoints", "Robot Initial States", "Language Instructions", "Light Conditions", "Background Textures", "Sensor Noise", "Objects Layout")


def dimensions(df: DataFrame, vectors: dict[str, Column]) -> DataFrame:
    """``key, dim, value`` of vectors; of matrices, every row counts."""
    parts = []
    for key, c in vectors.items():
        kind = df.select(c.alias("v")).schema["v"].dataType
        rows = df.select(F.explode(c).alias("v")) if kind.simpleString().startswith("array<array") else df.select(c.alias("v"))
        parts.append(rows.select(F.lit(key).alias("key"), F.posexplode("v").alias("dim", "value")).select("key", F.col("dim").cast("long"), F.col("value").cast("double")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def moments(values: DataFrame) -> DataFrame:
    """``mean, std`` (of the population), ``low, high, n`` for each (key, dim)."""
    return values.groupBy("key", "dim").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))


def merged_moments(parts: DataFrame) -> DataFrame:
    """Moments of all data from those of its parts: rows as of ``moments``, any number for each (key, dim).

    So new data adds to old statistics without the old data. Deviations are
    merged around the common mean, not as sums of squares, which would cancel.
    """
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    whole = parts.groupBy("key", "dim").agg(mean.alias("__mean"))
    off = F.col("mean") - F.col("__mean")
    spread = F.sqrt(F.sum(F.col("n") * (F.col("std") * F.col("std") + off * off)) / F.sum("n"))
    return parts.join(whole, ["key", "dim"]).groupBy("key", "dim").agg(F.first("__mean").alias("mean"), spread.alias("std"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def histogram_quantiles(values: DataFrame, quantiles: dict[str, float], bins: int = BINS, known: DataFrame | None = None) -> DataFrame:
    """The left edge of the first of ``bins`` equal bins in which the count reaches the quantile's share.

    Two passes: the range (or ``known`` moments, a staged table that has it), then
    counts by bin. The range, a row a dimension, is staged, so Spark knows how
    small it is and broadcasts it; values never meet it by key, of which there
    may be two.
    """
    known = staged(moments(values), "moments") if known is None else known
    bounds = known.select("key", "dim", (F.col("low") - PADDING).alias("low"), (F.col("high") + PADDING).alias("high"), "n")
    width = (F.col("high") - F.col("low")) / bins
    at = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("low")) / width)).cast("long")
    counts = values.join(bounds, ["key", "dim"]).groupBy("key", "dim", "low", "high", "n", at.alias("bin")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("key", "dim").orderBy("bin")))
    edge = lambda q: F.first("low") + F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("bin"))) * F.first(width)
    return upto.groupBy("key", "dim").agg(*(edge(q).alias(name) for name, q in quantiles.items()))


def norm_stats(values: DataFrame) -> DataFrame:
    """A row a key: ``mean, std, q01, q99`` as vectors. Fewer than two vectors are an error."""
    known = staged(moments(values), "moments")  # a row a dimension; the values are gone through twice in all
    both = known.join(histogram_quantiles(values, {"q01": 0.01, "q99": 0.99}, known=known), ["key", "dim"])
    few = F.raise_error(F.lit("statistics need two vectors at least")).cast("double")
    both = both.withColumn("mean", F.when(F.col("n") < 2, few).otherwise(F.col("mean")))
    lists = F.array_sort(F.collect_list(F.struct("dim", "mean", "std", "q01", "q99")))
    rows = both.groupBy("key").agg(lists.alias("s"))
    return rows.select("key", *(F.col(f"s.{x}").alias(x) for x in ("mean", "std", "q01", "q99")))


def norm_stats_json(stats: DataFrame) -> str:
    """The stats file's text; a row a key reaches the driver."""
    return json.dumps({"norm_stats": {r["key"]: {k: r[k] for k in ("mean", "std", "q01", "q99")} for r in stats.collect()}}, indent=2)


def rate(success: Column, total: Column) -> Column:
    return F.when(total > 0, success / total).otherwise(F.lit(0.0))


def suite_category_sums(shards: DataFrame) -> DataFrame:
    """Sums by suite and category, without rows named ``overall``; what is missing counts 0, overlaps count twice."""
    some = shards.filter(F.col("category") != "overall")
    zero = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)))
    return some.groupBy("suite", "category").agg(zero("total_count").alias("total"), zero("success_count").alias("success"))


def suite_overall(sums: DataFrame) -> DataFrame:
    """A row a suite, and one without suite for all."""
    r = sums.rollup("suite").agg(F.sum("total").alias("total"), F.sum("success").alias("success"))
    return r.withColumn("rate", rate(F.col("success"), F.col("total")))


def category_summary(sums: DataFrame) -> DataFrame:
    """Micro (pooled) and macro (mean of the suites that have any) rates by category."""
    own = F.when(F.col("total") > 0, F.col("success") / F.col("total"))
    c = sums.groupBy("category").agg(F.sum("total").alias("total"), F.sum("success").alias("success"), F.coalesce(F.avg(own), F.lit(0.0)).alias("macro"), F.count(own).alias("num_suites"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("suite", rate(F.col("success"), F.col("total")))))).alias("per_suite"))
    return c.withColumn("micro", rate(F.col("success"), F.col("total")))


def category_rank(category: Column, order: tuple[str, ...] = CATEGORY_ORDER) -> Column:
    return F.coalesce(F.create_map(*(x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i).cast("long"))))[category], F.lit(len(order)).cast("long"))


def dense_counts(categories: DataFrame, counts: DataFrame, *, key: str = "category", value: str = "n") -> DataFrame:
    """A row for every category, 0 where there is nothing."""
    return categories.join(counts, key, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def _with_quantiles(calls: DataFrame, group: str, ms: str, plain: list[Column], quantiles: dict[str, float]) -> DataFrame:
    """A row a group on either side, so the join is as small as the result."""
    from kinelake.operators.quantiles import exact_quantiles

    calls = staged(calls.select(group, ms), "calls")
    q = exact_quantiles(calls, [group], ms, quantiles).withColumnRenamed(group, "__group")
    return calls.groupBy(group).agg(*plain).join(q, F.col(group).eqNullSafe(F.col("__group")), "left").drop("__group")


def latency_quantiles(calls: DataFrame, group: str, ms: str = "ms") -> DataFrame:
    """By group: mean, deviation of the population, exact percentiles with interpolation."""
    return _with_quantiles(calls, group, ms, [F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("std")], {f"p{p}": p / 100 for p in (25, 50, 75, 90, 95, 99)})


def latency_summary(calls: DataFrame, group: str, ms: str = "ms") -> DataFrame:
    """By group: mean, median, range, deviation of the sample (0 for one value), calls a second."""
    return _with_quantiles(calls, group, ms, [F.avg(ms).alias("mean"), F.min(ms).alias("low"), F.max(ms).alias("high"), F.coalesce(F.stddev_samp(ms), F.lit(0.0)).alias("std"), (1000.0 / F.avg(ms)).alias("hz")], {"median": 0.5})


def control_rates(means: DataFrame, horizon: int, *, mean_s: str = "mean_s") -> DataFrame:
    """Rates (horizon / replan) / mean for replanning after 1, 5, 10 or all steps, as far as the horizon goes."""
    steps = sorted({s for s in (1, 5, 10, horizon) if s <= horizon})
    return means.withColumn("replan", F.explode(F.array(*(F.lit(s).cast("long") for s in steps)))).withColumn("rate", horizon / F.col("replan") / F.col(mean_s))


def logged_means(steps: DataFrame, interval: int, plain: list[str], optional: list[str], *, step: str = "step") -> DataFrame:
    """Means by logging window, which ends at each multiple of ``interval``: the first holds one step.

    ``optional`` columns count only where they have a value, the others as 0.
    """
    group = F.ceil(F.col(step) / interval).cast("long").alias("window")
    return steps.groupBy(group).agg(F.count("*").alias("steps"), *(F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in plain), *(F.avg(c).alias(c) for c in optional))


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the last by ``order``, as whoever writes last stays. Combined on the map side."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


#: Rows in a range of ``running_total`` (unless it is told another number), and the most ranges (a number each reaches the driver).
RANGE_ROWS, MOST_RANGES = 1_000_000, 10_000


def running_total(rows: DataFrame, key: str | list[str], value: Column | None = None, out: str = "before", range_rows: int | None = None) -> DataFrame:
    """``out``: the sum of ``value`` (None: the count) over the rows before each in the order of a key.

    Nothing is sorted in one task: Spark deals the rows out by ranges of about
    ``range_rows``, each is summed by itself, and moved by the sums of those
    before. Rows of one key are in the order of a hash of their columns, so a key
    that repeats very often is parted, too, and reruns agree. The rows are written
    to the shared folder first, so they are computed once.
    """
    keys, range_rows = [key] if isinstance(key, str) else key, range_rows or RANGE_ROWS
    value = F.lit(1).cast("long") if value is None else value
    rows = staged(rows, "rows")
    n = max(1, min(MOST_RANGES, -(-rows.count() // range_rows)))
    order = [*keys, "__tie"]
    plain = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    dealt = rows.withColumns({"__tie": F.xxhash64(*plain), "__value": value})
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("__value").over(w), F.lit(0).cast("long"))
    if n == 1:  # one range, so one task anyway
        return dealt.withColumn("__part", F.lit(0)).withColumn(out, within).select(*rows.columns, out)
    dealt = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("__part", F.spark_partition_id()), "ranges")
    total, before = 0, []
    for r in dealt.groupBy("__part").agg(F.sum("__value").alias("s")).orderBy("__part").collect():  # a row a range
        before.append((r["__part"], total))
        total += r["s"] or 0
    offsets = rows.sparkSession.createDataFrame(before, "__part int, __offset bigint")
    placed = dealt.withColumn("__within", within).join(F.broadcast(offsets), "__part")  # MOST_RANGES rows at most
    return placed.select(*rows.columns, (F.col("__offset") + F.col("__within")).alias(out))


def dense_positions(rows: DataFrame, key: str | list[str], range_rows: int | None = None) -> DataFrame:
    """``pos``: the place of each row in the order of a key, from 0."""
    return running_total(rows, key, out="pos", range_rows=range_rows)


def first_seen(rows: DataFrame, group: str, what: list[str], *order: str) -> DataFrame:
    return rows.groupBy(group).agg(F.min_by(F.struct(*what), F.struct(*order)).alias("f")).select(group, "f.*")


def dataset_totals(frames: DataFrame, *, episode: str = "episode", task: str = "task", size: int = 1000) -> DataFrame:
    e = F.count_distinct(episode)
    return frames.agg(F.count("*").alias("total_frames"), e.alias("total_episodes"), F.count_distinct(task).alias("total_tasks"), F.ceil(e / size).cast("long").alias("total_chunks"))


def checked_lengths(episodes: DataFrame, frames: DataFrame, *, episode: str = "episode", length: str = "length") -> DataFrame:
    """``episodes`` if each has as many frames as it says; else an error at the first that hasn't."""
    found = frames.groupBy(episode).agg(F.count("*").alias("__n"))
    wrong = F.raise_error(F.concat(F.lit("frames don't match the length of episode "), F.col(episode).cast("string"))).cast("long")
    return episodes.join(found, episode, "left").withColumn(length, F.when(F.coalesce("__n", F.lit(0)) == F.col(length), F.col(length)).otherwise(wrong)).drop("__n")


def moving_average(values: Column, decay: float) -> Column:
    """The end of d * old + (1 - d) * new over an array, from its first value."""
    return F.aggregate(F.slice(values, 2, 1 << 30), F.element_at(values, 1), lambda old, new: decay * old + (1 - decay) * new)


def global_norm(x: str) -> Column:
    return F.sqrt(F.sum(F.col(x) * F.col(x)))


def mean_interval(df: DataFrame, ts: str, *keys: str) -> DataFrame:
    """The mean time between successive stamps, and its inverse: what lies between all of them are the ends, so nothing is sorted."""
    mean = (F.max(ts) - F.min(ts)) / F.nullif(F.count(ts) - 1, F.lit(0))
    return df.groupBy(*keys).agg(mean.alias("mean_dt"), F.try_divide(F.lit(1), mean).alias("hz"))


def attention_grid(weights: DataFrame, cameras: int) -> DataFrame:
    """Mean attention over heads, then queries, on each camera's square grid; another shape is an error.

    ``weights``: ``batch, head, query, key, weight``.
    """
    by_query = weights.groupBy("batch", "query", "key").agg(F.avg("weight").alias("w"))
    by_key = by_query.groupBy("batch", "key").agg(F.avg("w").alias("w"))
    n = F.max("key").over(Window.partitionBy("batch")) + 1
    per = n / cameras
    side = F.sqrt(per).cast("long")
    ok = F.when(side * side == per, side).otherwise(F.raise_error(F.lit("the keys of a camera don't form a square")).cast("long"))
    at = by_key.withColumn("side", ok).withColumn("within", F.pmod("key", F.col("side") * F.col("side")))
    return at.select("batch", F.floor(F.col("key") / (F.col("side") * F.col("side"))).alias("camera"), F.floor(F.col("within") / F.col("side")).alias("row"), F.pmod("within", "side").alias("column"), "w")
