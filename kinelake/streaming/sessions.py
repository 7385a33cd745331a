"""State of an online loop: which step of which predicted chunk a session acts on.

Each has a batch twin (a window over recorded steps) and, for the chunk broker,
a streaming form with state. Event-time windows over a stream are an extension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinelake.operators import quantiles


def broker_positions(steps: DataFrame, horizon: int, *, session: str = "session", t: str = "t") -> DataFrame:
    """``position`` in the chunk, whether the step ``infers`` a new one, and at which step the chunk was made."""
    n = F.row_number().over(Window.partitionBy(session).orderBy(t)) - 1
    at = F.pmod(n, F.lit(horizon)).cast("long")
    w = Window.partitionBy(session).orderBy(t)
    made = F.last(F.when(F.col("infers"), F.col(t)), ignorenulls=True).over(w)
    return steps.withColumns({"position": at, "infers": at == 0}).withColumn("chunk_t", made)


def broker_actions(steps: DataFrame, horizon: int, *, chunk: str = "chunk", session: str = "session", t: str = "t") -> DataFrame:
    """The action of each step out of the chunk that its session predicted last (``horizon`` steps of each are used)."""
    w = Window.partitionBy(session).orderBy(t)
    placed = broker_positions(steps, horizon, session=session, t=t)
    held = F.last(F.when(F.col("infers"), F.col(chunk)), ignorenulls=True).over(w)
    return placed.withColumn("action", F.element_at(held, (F.col("position") + 1).cast("int")))


def replanned(steps: DataFrame, replan: int, *, chunk: str = "chunk", session: str = "session", t: str = "t") -> DataFrame:
    """As the broker with its own period; a chunk shorter than that is an error."""
    short = F.raise_error(F.lit("replanning needs longer chunks"))
    kind = steps.schema[chunk].dataType
    return broker_actions(steps.withColumn(chunk, F.when(F.size(chunk) >= replan, F.col(chunk)).otherwise(short.cast(kind))), replan, chunk=chunk, session=session, t=t)


def stream_broker(stream: DataFrame, horizon: int, *, session: str = "session", t: str = "t", ts: str | None = None, late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """The broker over a stream: ``session, t, position, infers``.

    Without ``ts`` steps must arrive in order from one micro-batch to the next;
    state is one counter a session. With ``ts`` (event time, not null) they may be
    ``late``: a step waits until the watermark has passed it, so positions are
    those of the batch form; later ones are dropped by the watermark. A session
    without steps for ``idle_ms`` is forgotten and starts anew.
    """
    kind = stream.schema[session].dataType.simpleString()
    out = f"{session} {kind}, {t} bigint, position bigint, infers boolean"

    def placed(key: tuple, steps: list[int], n: int) -> pd.DataFrame:
        at = [(n + i) % horizon for i in range(len(steps))]
        return pd.DataFrame({session: [key[0]] * len(steps), t: pd.Series(steps, dtype="int64"), "position": pd.Series(at, dtype="int64"), "infers": [x == 0 for x in at]})

    if ts is None:

        def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            (n,) = state.get if state.exists else (0,)
            steps = pd.concat(batches)[t].sort_values().tolist()
            state.update(((n + len(steps)) % horizon,))
            yield placed(key, steps, n)

        return stream.groupBy(session).applyInPandasWithState(step, out, "n bigint", "append", GroupStateTimeout.NoTimeout)

    def ordered(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, times, steps = state.get if state.exists else (0, [], [])
        held = list(zip(times, steps, strict=True))
        if not state.hasTimedOut:
            for b in batches:
                held += zip(b["__ms"].tolist(), b[t].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        ready, held = sorted(x for x in held if x[0] <= mark), sorted(x for x in held if x[0] > mark)
        if ready:
            yield placed(key, [x for _, x in ready], n)
        elif not held:  # nothing waits and nothing came: idle
            state.remove()
            return
        state.update(((n + len(ready)) % horizon, [x for x, _ in held], [x for _, x in held]))
        state.setTimeoutTimestamp(held[0][0] if held else mark + idle_ms)

    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(session, t, ts, F.unix_millis(ts).alias("__ms"))
    return timed.groupBy(session).applyInPandasWithState(ordered, out, "n bigint, times array<bigint>, steps array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def limited(steps: DataFrame, most: int, done: str, *, session: str = "session", t: str = "t") -> DataFrame:
    """Steps until an episode is done (that step included) or ``most`` steps are over."""
    w = Window.partitionBy(session).orderBy(t)
    before = F.coalesce(F.max(F.col(done).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return steps.withColumn("__n", F.row_number().over(w)).withColumn("__done", before).filter((F.col("__n") <= most) & (F.col("__done") == 0)).drop("__n", "__done")


def settled(steps: DataFrame, wait: int = 10, t: str = "t") -> DataFrame:
    """Without the first steps, which act as dummies."""
    return steps.filter(F.col(t) >= wait)


def previous_total(replies: DataFrame, *, session: str = "session", t: str = "t", total: str = "total") -> DataFrame:
    """Each reply with the time that the one before took."""
    return replies.withColumn("prev_total", F.lag(total).over(Window.partitionBy(session).orderBy(t)))


def with_hooks(stream: DataFrame, on_batch: Callable[[DataFrame, int], None]):
    """A writer that hands each micro-batch to subscribers."""
    return stream.writeStream.foreachBatch(on_batch)


class StreamStats:
    """Running moments over micro-batches, merged around the common mean.

    A micro-batch that Spark hands over again (``foreachBatch`` does so after a
    failure) counts once, as its number has been seen. With a ``path``, each
    update is a small table there, and a new driver goes on from what it finds.
    """

    def __init__(self, spark: SparkSession | None = None, path: str | None = None) -> None:
        self.path, self.epoch, self.parts = path, -1, {}
        if path and spark:
            self.restore(spark)

    def restore(self, spark: SparkSession) -> None:
        try:
            found = spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return
        self.epoch = found.agg(F.max("epoch")).first()[0]
        self.epoch = -1 if self.epoch is None else self.epoch
        for r in found.filter(F.col("epoch") == self.epoch).collect():  # a row a dimension
            self.parts[r["key"], r["dim"]] = (r["n"], r["mean"], r["std"])

    def update(self, values: DataFrame, epoch: int | None = None) -> None:
        """``values``: ``key, dim, value``. A row a dimension reaches the driver."""
        epoch = self.epoch + 1 if epoch is None else epoch
        if epoch <= self.epoch:
            return
        v = F.col("value")
        for r in values.groupBy("key", "dim").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).filter("n > 0").collect():
            n, mean, std = self.parts.get((r["key"], r["dim"]), (0, 0.0, 0.0))
            total, off = n + r["n"], r["mean"] - mean
            spread = n * std**2 + r["n"] * r["std"] ** 2 + off**2 * n * r["n"] / total
            self.parts[r["key"], r["dim"]] = total, mean + off * r["n"] / total, (spread / total) ** 0.5
        self.epoch = epoch
        if self.path:
            rows = [(epoch, *k, *p) for k, p in self.parts.items()]
            state = values.sparkSession.createDataFrame(rows, "epoch bigint, key string, dim bigint, n bigint, mean double, std double")
            state.coalesce(1).write.mode("append").parquet(self.path)

    def moments(self) -> dict[tuple[str, int], tuple[float, float]]:
        return {k: (mean, std) for k, (_, mean, std) in self.parts.items()}


class StreamQuantiles:
    """Histograms over a stream's micro-batches, as a table: ``quantiles.merged_grids`` after each.

    ``path`` holds a snapshot an epoch, made of the one before and the micro-batch;
    the last two are kept. So a micro-batch that Spark hands over again makes the
    same snapshot again, a new driver goes on from the newest, and the result is
    that of all values at once, however they were cut. Nothing reaches the driver.
    A path belongs to one checkpoint.
    """

    def __init__(self, path: str, bins: int = 5000) -> None:
        self.path, self.bins = path, bins

    def epochs(self, spark: SparkSession) -> list[int]:
        """Of the snapshots there are, by the names of their folders."""
        jvm = spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n.removeprefix("epoch-")) for n in names if n.startswith("epoch-"))

    def snapshot(self, spark: SparkSession, epoch: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/epoch-{epoch}")

    def update(self, values: DataFrame, epoch: int) -> None:
        """``values``: ``key, dim, value``."""
        spark = values.sparkSession
        before = [e for e in self.epochs(spark) if e < epoch]
        grid = quantiles.grid_histogram(values, bins=self.bins)
        if before:
            grid = quantiles.merged_grids(self.snapshot(spark, before[-1]).unionByName(grid), bins=self.bins)
        grid.write.mode("overwrite").parquet(f"{self.path}/epoch-{epoch}")
        for old in before[:-1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/epoch-{old}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def quantiles(self, spark: SparkSession, wanted: dict[str, float]) -> DataFrame:
        """``key, dim`` and a column for each of ``wanted``."""
        return quantiles.grid_quantiles(self.snapshot(spark, self.epochs(spark)[-1]), wanted)


def windowed_counts(stream: DataFrame, *, ts: str = "ts", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Extension: counts and sums by event-time window and type, with a watermark (needs a zoned time stamp)."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
