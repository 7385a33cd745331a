"""Quantiles of groups of any size, exact by selection or from histograms that merge.

``F.percentile`` holds every distinct value of a group in one task. Selection
holds counters only; a histogram on a power-of-two grid is kept as a table to
which parts may be added in any order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.sources.shared import staged

#: Counters of a bucket in one pass; a bucket of so many values or fewer is sorted as an array.
DIGITS, FEW = 1024, 4096


def exact_quantiles(rows: DataFrame, group: Sequence[str], value: str, quantiles: Mapping[str, float], few: int = FEW, digits: int = DIGITS) -> DataFrame:
    """``group`` and a column for each of ``quantiles``, with linear interpolation between neighbours.

    Selection by digits: values are counted in ``digits`` bins of their range, of
    which only those that hold a wanted rank are looked into again, by bins of
    their own range. A bin of one repeated value, or of no more than ``few`` values,
    is settled at once, as are small groups. A pass is one aggregation, combined
    on the map side; it shuffles a counter a bin and task. The wanted buckets (a
    row a group of more than ``few`` values and rank) are broadcast if Spark finds
    them small. Nulls don't count; NaN is the largest value; a group without
    values has no row, and null is a group like others.
    """
    source = rows.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    source = staged(source, "values")
    if (source.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) <= few:  # so a buffer holds no more
        return source.groupBy(*group).agg(*(F.percentile("__v", F.lit(float(q))).alias(name) for name, q in quantiles.items()))
    sizes = staged(source.groupBy(*group).agg(F.count("*").alias("__n"), F.count(F.when(~F.isnan("__v"), 1)).alias("__m"), F.min("__v").alias("__low"), F.max(F.when(~F.isnan("__v"), F.col("__v"))).alias("__high")), "sizes")
    # Ranks that are wanted: below and above each quantile's place.
    places = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("__n") - 1)).alias("at")) for name, q in quantiles.items()))
    wanted = sizes.select(*group, "__m", "__low", "__high", F.explode(places).alias("p"))
    ranks = F.array_distinct(F.array(F.floor("p.at"), F.ceil("p.at")))
    wanted = wanted.select(*group, "__m", "__low", "__high", F.explode(ranks).alias("__rank")).distinct()
    nan = wanted.filter(F.col("__rank") >= F.col("__m")).select(*group, "__rank", F.lit(float("nan")).alias("__v"))
    open_ = wanted.filter(F.col("__rank") < F.col("__m")).groupBy(*group, "__low", "__high", F.col("__m").alias("__count")).agg(F.collect_set("__rank").alias("__ranks"))
    open_ = open_.withColumn("__before", F.lit(0).cast("long"))
    found = [nan]
    numbers = source.filter(~F.isnan("__v"))
    while True:
        open_ = staged(open_, "buckets")
        one = open_.filter(F.col("__low") == F.col("__high"))
        found.append(one.select(*group, F.explode("__ranks").alias("__rank"), F.col("__low").alias("__v")))
        small = open_.filter((F.col("__low") != F.col("__high")) & (F.col("__count") <= few))
        own = [*group, "__low", "__high", "__before", "__ranks"]
        lists = _inside(numbers, small, group).groupBy(*own).agg(F.array_sort(F.collect_list("__v")).alias("__all"))  # ``few`` values at most
        settled = lists.select(*group, "__all", "__before", F.explode("__ranks").alias("__rank"))
        found.append(settled.select(*group, "__rank", F.element_at("__all", (F.col("__rank") - F.col("__before") + 1).cast("int")).alias("__v")))
        large = open_.filter((F.col("__low") != F.col("__high")) & (F.col("__count") > few))
        if large.isEmpty():
            break
        binned = _inside(numbers, large, group).groupBy(*own, _digit(digits).alias("__bin")).agg(F.count("*").alias("__count"), F.min("__v").alias("__first"), F.max("__v").alias("__last"))
        upto = F.sum("__count").over(Window.partitionBy(*group, "__low").orderBy("__bin"))  # ``digits`` rows
        binned = binned.withColumn("__upto", F.col("__before") + upto).withColumn("__before", F.col("__upto") - F.col("__count"))
        inside = F.filter("__ranks", lambda r: (r >= F.col("__before")) & (r < F.col("__upto")))
        open_ = binned.withColumn("__ranks", inside).filter(F.size("__ranks") > 0).select(*group, F.col("__first").alias("__low"), F.col("__last").alias("__high"), "__count", "__ranks", "__before")
    ranked = found[0]
    for f in found[1:]:
        ranked = ranked.unionByName(f)
    values = ranked.groupBy(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group))).agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__of"))  # two ranks a quantile
    same = F.lit(True)
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    both = sizes.join(values, same)

    def between(q: float) -> Column:
        at = F.lit(float(q)) * (F.col("__n") - 1)
        low, high = F.col("__of")[F.floor(at)], F.col("__of")[F.ceil(at)]
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    return both.select(*group, *(between(q).alias(name) for name, q in quantiles.items()))


def _inside(numbers: DataFrame, buckets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Values with the bucket they are in; buckets of a group don't overlap."""
    b = buckets.select(*(F.col(g).alias(f"__b{i}") for i, g in enumerate(group)), "__low", "__high", "__before", "__ranks")
    same = (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high"))
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__b{i}"))
    return numbers.join(b, same)


def _digit(digits: int) -> Column:
    """The bin of a value, never lower for a larger one. The ends have bins of their own, so every pass parts a bucket."""
    v, low, high = F.col("__v"), F.col("__low"), F.col("__high")
    share = (v / 2 - low / 2) / F.nullif(high / 2 - low / 2, F.lit(0.0)) * (digits - 2)  # halves don't overflow
    middle = F.when(share.isNull() | F.isnan(share), F.lit(1)).otherwise(F.greatest(F.lit(1), F.least(F.lit(digits - 2), F.floor(share).cast("int") + 1)))
    return F.when(v == low, F.lit(0)).when(v == high, F.lit(digits - 1)).otherwise(middle)


def grid_exponent(low: Column, high: Column, bins: int) -> Column:
    """The least e (-1000 at least) for which the cells of width 2 ** e that cover ``low`` to ``high`` are no more than ``bins``."""
    first = F.coalesce(F.ceil(F.log2(F.nullif(high - low, F.lit(0.0)) / bins)), F.lit(-1000)).cast("int")
    fits = lambda e: _cell(high, e) - _cell(low, e) < bins
    # The logarithm may be off by one, and an unlucky start costs a cell more. A single value needs cells that whole numbers can count.
    near = F.greatest(F.lit(-1000), first - 1, F.ceil(F.log2(F.nullif(F.greatest(F.abs(low), F.abs(high)), F.lit(0.0)))).cast("int") - 52)
    return F.coalesce(*(F.when(fits(near + k), near + k) for k in range(3)), near + 3)


def _cell(v: Column, e: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), e)).cast("long")  # exact: a power of two changes the exponent only


def grid_histogram(values: DataFrame, keys: Sequence[str] = ("key", "dim"), value: str = "value", bins: int = 5000) -> DataFrame:
    """``keys, e, cell, c, low, high``: counts by cells of width 2 ** e, at most ``bins`` of them, and the range of each key.

    The width follows from the range alone, so parts merge exactly: see
    ``merged_grids``. Nulls and NaN don't count; values must be finite.
    """
    some = values.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("__v"))
    ranges = staged(some.groupBy(*keys).agg(F.min("__v").alias("low"), F.max("__v").alias("high")).withColumn("e", grid_exponent(F.col("low"), F.col("high"), bins)), "ranges")
    return some.join(ranges, list(keys)).groupBy(*keys, "e", "low", "high", _cell(F.col("__v"), F.col("e")).alias("cell")).agg(F.count("*").alias("c"))


def merged_grids(parts: DataFrame, keys: Sequence[str] = ("key", "dim"), bins: int = 5000) -> DataFrame:
    """The histogram of all data from those of its parts, the same in whatever order and grouping they are merged.

    A cell of a coarser grid holds whole cells of a finer one: floor(v / 2**(e + k))
    = floor(floor(v / 2**e) / 2**k); and the exponent of the whole is no less than
    that of any part, as it follows from the range.
    """
    ranges = parts.groupBy(*keys).agg(F.min("low").alias("__low"), F.max("high").alias("__high")).withColumn("__e", grid_exponent(F.col("__low"), F.col("__high"), bins))
    both = parts.join(ranges, list(keys))
    shifted = F.floor(F.col("cell") / F.pow(F.lit(2.0), F.col("__e") - F.col("e"))).cast("long")
    return both.groupBy(*keys, F.col("__e").alias("e"), F.col("__low").alias("low"), F.col("__high").alias("high"), shifted.alias("cell")).agg(F.sum("c").alias("c"))


def grid_quantiles(grid: DataFrame, quantiles: Mapping[str, float], keys: Sequence[str] = ("key", "dim")) -> DataFrame:
    """``keys`` and the left edge of the first cell up to which a share q of all values lies; not below the least value."""
    over = Window.partitionBy(*keys)
    some = grid.withColumns({"__upto": F.sum("c").over(over.orderBy("cell")), "__n": F.sum("c").over(over)})  # ``bins`` rows a key
    edge = lambda q: F.min(F.when(F.col("__upto") >= F.lit(float(q)) * F.col("__n"), F.greatest(F.col("low"), F.col("cell") * F.pow(F.lit(2.0), F.col("e")))))
    return some.groupBy(*keys).agg(*(edge(q).alias(name) for name, q in quantiles.items()))
