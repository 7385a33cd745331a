"""Operators along an episode: look-ahead, idle segments, pooling, numbering.

All windows of one call share a partitioning by episode, so the data are
shuffled once; images and the like should be joined back afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.functions import vectors
from kinelake.operators.aggregates import running_total
from kinelake.operators.scans import last, segmented_scan


def action_chunks(frames: DataFrame, horizon: int, *, episode: str = "episode", t: str = "t", action: str = "action", out: str = "chunk") -> DataFrame:
    """Each frame's next ``horizon`` actions; past the end, the last one repeats."""
    w = Window.partitionBy(episode).orderBy(t).rowsBetween(0, horizon - 1)
    ahead = F.collect_list(action).over(w)
    return frames.withColumn(out, ahead).withColumn(out, F.concat(F.col(out), F.array_repeat(F.element_at(out, -1), horizon - F.size(out))))


def at_offsets(frames: DataFrame, offsets: Sequence[int], *, episode: str = "episode", t: str = "t", value: str = "action", out: str = "values") -> DataFrame:
    """The values at frame offsets (either sign); beyond the ends, the first or last one."""
    w = Window.partitionBy(episode).orderBy(t)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = {-1: F.first(value).over(whole), 1: F.last(value).over(whole)}
    pick = [F.col(value) if k == 0 else F.coalesce(F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w), beyond[1 if k > 0 else -1]) for k in offsets]
    return frames.withColumn(out, F.array(*pick))


def idle(frames: DataFrame, threshold: float = 1e-3, *, episode: str = "episode", t: str = "t", vector: str = "vector") -> DataFrame:
    """``idle``: no dimension moved by ``threshold`` or more since the frame before. The first frame isn't idle."""
    before = F.lag(vector).over(Window.partitionBy(episode).orderBy(t))
    still = F.forall(F.zip_with(F.col(vector), before, lambda a, b: F.abs(a - b) < threshold), lambda x: x)
    return frames.withColumn("idle", F.coalesce(still, F.lit(False)))


def runs(frames: DataFrame, flag: str, *, episode: str = "episode", t: str = "t") -> DataFrame:
    """Maximal runs of equal ``flag``: ``episode, flag, start, end`` (half open)."""
    w = Window.partitionBy(episode).orderBy(t)
    new = F.coalesce(F.col(flag) != F.lag(flag).over(w), F.lit(True)).cast("int")
    numbered = frames.withColumn("run", F.sum(new).over(w))
    return numbered.groupBy(episode, "run", flag).agg(F.min(t).alias("start"), (F.max(t) + 1).alias("end")).drop("run")


def keep_ranges(frames: DataFrame, *, least_idle: int = 7, least_kept: int = 16, cut: int = 10, episode: str = "episode", t: str = "t", flag: str = "idle") -> DataFrame:
    """Ranges worth training on: idle runs of ``least_idle`` and more go; of what is left, runs of ``least_kept`` and more lose their last ``cut`` frames."""
    w = Window.partitionBy(episode).orderBy(t)
    new = F.coalesce(F.col(flag) != F.lag(flag).over(w), F.lit(True)).cast("int")
    numbered = frames.select(episode, t, flag).withColumn("run", F.sum(new).over(w))
    length = F.count("*").over(Window.partitionBy(episode, "run"))
    marked = numbered.withColumn("kept", ~(F.col(flag) & (length >= least_idle))).drop("run")
    return runs(marked, "kept", episode=episode, t=t).filter(F.col("kept") & (F.col("end") - F.col("start") >= least_kept)).select(episode, "start", (F.col("end") - cut).alias("end"))


def range_lists(ranges: DataFrame, episodes: DataFrame, *, episode: str = "episode") -> DataFrame:
    """Every episode with its ranges in order; an episode without any has an empty list."""
    lists = ranges.groupBy(episode).agg(F.array_sort(F.collect_list(F.array("start", "end"))).alias("ranges"))
    return episodes.select(episode).join(lists, episode, "left").withColumn("ranges", F.coalesce("ranges", F.array().cast("array<array<bigint>>")))


def reindex(frames: DataFrame, order: DataFrame, *, episode: str = "episode", t: str = "t") -> DataFrame:
    """New dense numbers: ``order`` has ``episode, new_episode``; ``index`` runs over all frames.

    The running offset is taken over one row an episode, not over frames, and by
    ranges of numbers, not in one task.
    """
    lengths = frames.groupBy(episode).agg(F.count("*").alias("length")).join(order, episode)
    offsets = running_total(lengths, "new_episode", F.col("length"), "offset")
    place = F.row_number().over(Window.partitionBy(episode).orderBy(t)) - 1
    return frames.withColumn("frame_index", place.cast("long")).join(offsets.drop("length"), episode).withColumn("index", F.col("offset") + F.col("frame_index")).drop("offset")


def spread_picks(episodes: DataFrame, n: int, *, episode: str = "episode", length: str = "length") -> DataFrame:
    """``n`` evenly spread frames of each episode, with their global index: at (k + 1/2)(L - 1)/n, cut to whole frames; the first for n = 1."""
    offsets = running_total(episodes, episode, F.col(length), "offset").filter(F.col(length) >= 1)
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    at = F.lit(0) if n == 1 else F.least(F.floor((F.col("k") + 0.5) * (F.col(length) - 1) / n), F.col(length) - 1)
    return offsets.select(episode, "offset", length, k).withColumn("frame", at.cast("long")).select(episode, F.col("k").cast("long").alias("k"), "frame", (F.col("offset") + F.col("frame")).alias("index"))


def uniform_picks(total: Column, n: int) -> Column:
    """Indices of ``n`` frames with both ends, halves rounded to even; all if there are no more than ``n``."""
    if n == 1:
        return F.array(F.floor(total / 2))
    some = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.rint(i * (total - 1) / (n - 1)).cast("long"))
    return F.when(total <= n, F.sequence(F.lit(0).cast("long"), total.cast("long") - 1)).otherwise(some)


def aligned_length(n: Column) -> Column:
    """The next length of the form 4n + 1."""
    return F.floor((n + 2) / 4) * 4 + 1


def tubelet_length(n: Column, k: int) -> Column:
    return F.ceil(n / k) * k


def pad_last(x: Column, n: Column) -> Column:
    """Filled to ``n`` with the last value."""
    return F.concat(x, F.array_repeat(F.element_at(x, -1), F.greatest(n - F.size(x), F.lit(0)).cast("int")))


def temporal_group(t: Column) -> Column:
    """Frame 0 alone, then groups of four."""
    return F.ceil(t / 4).cast("long")


def temporal_pool(frames: DataFrame, value: str, *, episode: str = "episode", t: str = "t") -> DataFrame:
    """The mean of each temporal group; the last one may be partial."""
    return frames.groupBy(episode, temporal_group(F.col(t)).alias("group")).agg(F.avg(value).alias(value))


def group_deltas(deltas: Sequence[int]) -> list[float]:
    """The mean frame offset of each temporal group."""
    groups = [deltas[:1], *(deltas[i : i + 4] for i in range(1, len(deltas), 4))]
    return [sum(g) / len(g) for g in groups]


def decay_weights(x: Column, alpha: float) -> Column:
    """Weights exp(-alpha t) over an array's positions, adding up to one."""
    raw = F.transform(x, lambda _, t: F.exp(-alpha * t))
    return F.transform(raw, lambda v: v / vectors.total(raw))


def causal_mask(tokens: DataFrame, *, sequence: str = "seq", position: str = "pos", starts: str = "ar", valid: str = "valid") -> DataFrame:
    """``seq, i, j, attends``: j's block is not after i's, and both are valid. Pairs stay within a sequence."""
    block = F.sum(starts).over(Window.partitionBy(sequence).orderBy(position))
    t = tokens.select(sequence, F.col(position).alias("i"), block.alias("bi"), F.col(valid).alias("vi"))
    u = t.select(sequence, F.col("i").alias("j"), F.col("bi").alias("bj"), F.col("vi").alias("vj"))
    return t.join(u, sequence).select(sequence, "i", "j", ((F.col("bj") <= F.col("bi")) & F.col("vi") & F.col("vj")).alias("attends"))


def causal_prefixes(tokens: DataFrame, *, sequence: str = "seq", position: str = "pos", starts: str = "ar", valid: str = "valid") -> DataFrame:
    """The causal mask with a row a token: ``seq, i, end, valid``.

    As blocks only grow along a sequence, a token attends to all valid ones before
    ``end``, where the next block starts (null: none does, so it is the sequence's
    end), and to none if it isn't valid itself. Which are valid is a property of
    keys, so it isn't repeated for each query: see ``valid_runs``. A long sequence
    is scanned in ranges.
    """
    rows = tokens.select(sequence, F.col(position).alias("i"), F.col(valid).alias("valid"), F.when(F.col(starts) > 0, F.col(position)).alias("__start"))
    return segmented_scan(rows, [sequence], [F.desc("i")], {"end": last("__start")}).select(sequence, "i", "end", "valid")


def valid_runs(tokens: DataFrame, *, sequence: str = "seq", position: str = "pos", valid: str = "valid") -> DataFrame:
    """``seq, start, end`` of the runs of valid tokens, in ranges where a sequence is long."""
    rows = tokens.select(sequence, F.col(position).alias("i"), F.coalesce(valid, F.lit(False)).alias("valid"))
    # A run starts after the last token that isn't valid, and is told by that.
    rows = segmented_scan(rows.withColumn("__gap", F.when(~F.col("valid"), F.col("i"))), [sequence], ["i"], {"__after": last("__gap")})
    runs_ = rows.filter("valid").groupBy(sequence, "__after").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"))
    return runs_.drop("__after")


def expand_mask(prefixes: DataFrame, valid_keys: DataFrame, *, sequence: str = "seq") -> DataFrame:
    """``seq, i, j`` of all pairs that attend: for whom pairs are the result that is wanted."""
    k = valid_keys.withColumnRenamed(sequence, "__seq")
    seen = prefixes.withColumnRenamed("end", "__stop").filter("valid").join(k, (F.col(sequence) == F.col("__seq")) & (F.col("__stop").isNull() | (F.col("start") < F.col("__stop"))))
    until = F.least(F.col("end"), F.coalesce("__stop", F.col("end")))
    return seen.select(sequence, "i", F.explode(F.sequence(F.col("start"), until - 1)).alias("j"))


def position_ids(tokens: DataFrame, *, sequence: str = "seq", position: str = "pos", valid: str = "valid") -> DataFrame:
    return tokens.withColumn("position_id", F.sum(F.col(valid).cast("long")).over(Window.partitionBy(sequence).orderBy(position)) - 1)


def align_right(x: Column, valid: Column) -> Column:
    """Rolled so that the last valid value stands last."""
    last = F.array_position(F.reverse(valid), True)  # counted from the end
    n = F.when(last == 0, F.lit(0)).otherwise(F.size(x) - last + 1).cast("int")
    return F.concat(F.slice(x, n + 1, F.size(x) - n), F.slice(x, F.lit(1), n))
