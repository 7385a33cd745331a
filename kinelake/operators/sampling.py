"""Order, subsets, mixtures, batches, and splits over workers.

What the reference draws at random is here a function of keys and a seed, so
that reruns agree. Dense positions come from ``aggregates.dense_positions``
where a whole table is numbered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators.aggregates import dense_positions


def permutation(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``episode, new_episode``: NumPy's permutation of ``n`` episodes.

    It is made on the driver, as only NumPy's generator gives it: two arrays of 8
    bytes an episode, which go to Spark as they are. ``shuffle_key`` has no bound.
    """
    p = np.random.default_rng(seed).permutation(n)
    return spark.createDataFrame(pa.table({"episode": p, "new_episode": np.arange(n)}))


def shuffle_key(key: Column, seed: int) -> Column:
    """A pseudo-random order by arithmetic on whole keys, the same in any engine."""
    return F.pmod(key * 7919 + seed * 104729 + F.pmod(key, F.lit(97)) * 15485863, F.lit(2147483647))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in pseudo-random order: a full shuffle, stronger than a buffer's."""
    return df.orderBy(shuffle_key(F.col(key), seed), key)


def subset_size(n: Column, ratio: float) -> Column:
    """At least one; halves round to even."""
    return F.greatest(F.lit(1).cast("long"), F.rint(n * ratio).cast("long"))


def nested_subsets(order: DataFrame, ratios: Mapping[str, float], place: str = "new_episode") -> DataFrame:
    """``subset`` and row for prefixes of one order: smaller subsets lie in larger ones."""
    n = F.lit(order.count())
    names = F.filter(F.array(*(F.when(F.col(place) < subset_size(n, r), F.lit(name)) for name, r in ratios.items())), lambda x: x.isNotNull())
    return order.withColumn("subset", F.explode(names))


def quota_mixture(df: DataFrame, weights: Mapping[str, float], total: int, *, dataset: str = "dataset", position: str = "pos") -> DataFrame:
    """``round(weight * total)`` rows of each dataset, repeating it from the start when it is too short.

    ``position``: each row's place in its dataset, from 0. Weights must add up to
    one, and a dataset with a quota must have rows; else the mix would be short.
    """
    if abs(sum(weights.values()) - 1.0) > 1e-9:
        raise ValueError(f"weights add up to {sum(weights.values())}, not to one")
    quota = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.lit(int(round(w * total))).cast("long"))))[F.col(dataset)]
    sizes = df.filter(F.col(dataset).isin(*weights)).groupBy(dataset).agg(F.count("*").alias("__size"))
    found = {r[0] for r in sizes.select(dataset).collect()}  # no more than there are weights
    if missing := [k for k, w in weights.items() if round(w * total) > 0 and k not in found]:
        raise ValueError(f"no rows to draw from in {missing}")
    times = F.ceil((quota - F.col(position)) / F.col("__size")).cast("long")
    rows = df.join(sizes, dataset).filter(quota > F.col(position))
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1))).drop("__size")


#: The longest schedule that ``interleaved`` makes on the driver: the common denominator of its weights.
MOST_STEPS = 1_000_000


def schedule(weights: Mapping[str, float]) -> list[str]:
    """The order in which datasets take turns, to be repeated without end.

    Any first n turns, over any number of rounds, hold less than one more or less
    than weight * n of each dataset (the quota method: of the datasets that are
    behind their share, the next turn goes to the one with the largest weight a
    turn). Weights are taken as the decimal fractions they are written as.
    """
    parts = {k: Fraction(str(w)) for k, w in weights.items() if w > 0}
    if sum(parts.values()) != 1:
        raise ValueError(f"weights add up to {float(sum(parts.values()))}, not to one")
    steps = lcm(*(f.denominator for f in parts.values()))
    if steps > MOST_STEPS:
        raise ValueError(f"these weights have a common denominator of {steps}, more than {MOST_STEPS}")
    names, quota = list(parts), np.array([int(f * steps) for f in parts.values()])
    taken, turns = np.zeros(len(names), np.int64), []
    for n in range(1, steps + 1):
        turn = int(np.argmax(np.where(taken * steps < quota * n, quota / (taken + 1), -1.0)))
        taken[turn] += 1
        turns.append(names[turn])
    return turns


def interleaved(df: DataFrame, weights: Mapping[str, float], total: int, *, dataset: str = "dataset", position: str = "pos") -> DataFrame:
    """The first ``total`` rows of an endless weighted interleave: ``place`` (from 0) and ``epoch``.

    Every dataset repeats without end, its rows in the order of ``position`` (dense,
    from 0). As turns follow a schedule that repeats, a row's places follow from its
    position alone: nothing is merged or sorted, and any prefix holds its share of
    each dataset within one row. The schedule is a small table (a row a turn,
    ``MOST_STEPS`` at most); a dataset with a weight must have rows.
    """
    turns = schedule(weights)
    steps = len(turns)
    count: dict[str, int] = {}
    slots = []
    for slot, name in enumerate(turns):
        slots.append((name, count.get(name, 0), slot))
        count[name] = count.get(name, 0) + 1
    spark = df.sparkSession
    sizes = df.filter(F.col(dataset).isin(*count)).groupBy(dataset).agg(F.count("*").alias("__size")).collect()  # no more than there are weights
    if missing := sorted(set(count) - {r[0] for r in sizes}):
        raise ValueError(f"no rows to draw from in {missing}")
    known = F.create_map(*(x for name, n in sizes for x in (F.lit(name), F.struct(F.lit(n).alias("size"), F.lit(count[name]).alias("quota")))))
    own = df.filter(F.col(dataset).isin(*count)).withColumn("__of", known[F.col(dataset)])
    # The draws of a row: every ``size``-th of its dataset, as long as they may stand before ``total``.
    most = (F.lit(total // steps + 1) * F.col("__of.quota") - F.col(position)) / F.col("__of.size")
    epochs = F.when(most > 0, F.sequence(F.lit(0).cast("long"), F.ceil(most).cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    draws = own.withColumn("epoch", F.explode(epochs)).withColumn("__k", F.col("epoch") * F.col("__of.size") + F.col(position))
    draws = draws.withColumns({"__round": F.floor(F.col("__k") / F.col("__of.quota")), "__turn": F.col("__k") % F.col("__of.quota")})
    table = spark.createDataFrame(slots, "__name string, __nth bigint, __slot bigint")
    placed = draws.join(F.broadcast(table), (F.col(dataset) == F.col("__name")) & (F.col("__turn") == F.col("__nth")))  # MOST_STEPS rows
    placed = placed.withColumn("place", F.col("__round") * steps + F.col("__slot")).filter(F.col("place") < total)
    return placed.drop("__of", "__k", "__round", "__turn", "__name", "__nth", "__slot")


def buffered(df: DataFrame, size: int, seed: int, *, place: str = "place", out: str = "at") -> DataFrame:
    """``out``: a key whose order shuffles that of ``place`` (dense whole numbers) as a buffer of ``size`` rows does.

    Rows move by less than ``size`` places either way, so a mixture stays one; no
    row waits for others, and reruns agree. Sort by (``out``, ``place``).
    """
    return df.withColumn(out, F.col(place) + F.pmod(F.xxhash64(place, F.lit(seed)), F.lit(size)))


def repeated(df: DataFrame, epochs: int) -> DataFrame:
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))


def batches(df: DataFrame, size: int, *, position: str = "pos", drop_last: bool = True) -> DataFrame:
    """``batch`` of consecutive rows by dense position; an incomplete last batch goes if asked for."""
    out = df.withColumn("batch", F.floor(F.col(position) / size).cast("long"))
    if drop_last:
        n = df.agg(F.count("*")).first()[0]
        if n < size:
            raise ValueError(f"{n} rows are fewer than a batch of {size}")
        out = out.filter(F.col("batch") < n // size)
    return out


def whole_batches(df: DataFrame, size: int, key: str) -> DataFrame:
    """The rows that full batches of ``size`` take in the order of a distinct key; no row is numbered.

    Only the last batch can be short: its rows, fewer than ``size``, are found from the end.
    """
    n = df.count()
    if n < size:
        raise ValueError(f"{n} rows are fewer than a batch of {size}")
    rest = df.select(key).orderBy(F.desc(key)).limit(n % size).collect() if n % size else []
    return df.filter(F.col(key) < F.lit(rest[-1][0])) if rest else df


def numbered(df: DataFrame, key: str) -> DataFrame:
    return dense_positions(df, key)


def strided(df: DataFrame, world: int, position: str = "pos") -> DataFrame:
    return df.withColumn("rank", F.pmod(F.col(position), F.lit(world)).cast("long"))


def contiguous(position: Column, total: Column, workers: int) -> Column:
    """The worker of a position: equal runs, the last worker takes the rest; all to it if there are fewer items than workers."""
    each = F.floor(total / workers)
    return F.when(each == 0, F.lit(workers - 1)).otherwise(F.least(F.floor(position / F.greatest(each, F.lit(1))), F.lit(workers - 1))).cast("long")


def by_locality(df: DataFrame, *keys: str) -> DataFrame:
    """Ranges of keys together and sorted within, for what reads neighbours."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def longest_first(suites: DataFrame, steps: str = "max_steps", start: str = "start") -> DataFrame:
    return suites.orderBy(F.desc(steps), start)


def sample_k(df: DataFrame, k: int, key: str, seed: int) -> DataFrame:
    """``k`` rows without replacement, by a pseudo-random order; ``k`` is what is asked for."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(k)


def nearest_candidate(candidates: Column, error: Callable[[Column], Column]) -> Column:
    """Of an array of candidates, the one of least error; of equals, the lowest. All of it happens within a row."""
    return F.array_min(F.transform(candidates, lambda c: F.struct(error(c).alias("e"), c.alias("c"))))["c"]


def closest_name(names: DataFrame, name: str, column: str = "name") -> DataFrame:
    return names.withColumn("distance", F.levenshtein(F.col(column), F.lit(name))).orderBy("distance", column).limit(1)
