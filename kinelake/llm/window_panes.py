"""Hourly panes over a stream, published once they are due and revised while they are open.

Each task adds the rows of its part of a micro-batch up by pane before they are
shuffled, without state, so that of a pane that holds a third of all rows a row a
task is moved. One operator with state, keyed by ``Shard``, takes these sums:
there is a fixed number of shards, and a pane belongs to one by a hash. A shard
adds what comes to its open panes and publishes nothing until a punctuation ends
the batch; then it decides what is published, revised, or closed. Rows of panes
that are closed already need no state and pass by.

A batch is a folder of files, and the punctuation is its last file, so it ends
the batch even if Spark cuts that into several micro-batches, and ends an empty
one as well. Time is told by the punctuation only, never by a clock: a restarted
query gives the same records.

There is one operator because each start opens a store a partition and operator,
and Spark 4.1 leaves some native memory of each (its statistics) with the executor.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from kinelake.llm import common

#: Shards that the rows of a batch are dealt to; hours after a pane's end at which it is due and closed.
SHARDS, DUE, CLOSED = 24, 12, 48
#: Stands for minus infinity: no row came before.
NEVER = -(1 << 62)

_ROWS = "shard int, hour bigint, kind string, click_id bigint, cents bigint, mark int, watermark bigint, last int"
_SUMS = "shard int, hour bigint, kind string, n_rows bigint, cents bigint, mark int, watermark bigint, last int"
_RECORDS = "batch bigint, hour bigint, kind string, n_rows bigint, cents bigint, record string"
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A start loads all stores anew anyway; those of earlier starts would stay on local disks, some MB each.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    # One cache and one limit of write buffers an executor, not some for each store.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    # Commits by rename: the other manager starts processes for each of the many small files where Hadoop has no native library.
    "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a pane of a task's rows, and the punctuation as it is."""
    by, held = ["shard", "hour", "kind", "mark", "watermark", "last"], []
    for part in batches:
        held.append(part.groupby(by, as_index=False)["cents"].agg(n_rows="count", cents="sum"))
        if len(held) == 64:
            held = [_added(held, by)]
    if held:
        yield _added(held, by)[["shard", "hour", "kind", "n_rows", "cents", "mark", "watermark", "last"]]


def _added(parts: list[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(parts).groupby(by, as_index=False)[["n_rows", "cents"]].sum()


class Shard(StatefulProcessor):
    """Open panes: their totals up to the last batch, what this batch has added so far, and whether they are published.

    Memory and state hold a row an open pane.
    """

    def __init__(self, batch: int, due: int, closed: int):
        self.batch, self.due, self.closed = batch, due, closed

    def init(self, handle) -> None:
        self.open = handle.getListState("open", "hour bigint, kind string, n_rows bigint, cents bigint, new_rows bigint, new_cents bigint, published boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        panes = {(hour, kind): tuple(rest) for hour, kind, *rest in self.open.get()}
        mark = None
        for part in rows:
            marks = part[part["mark"] == 1]
            if len(marks):
                mark = int(marks["watermark"].iloc[0]), int(marks["last"].iloc[0])
            new = part[part["mark"] == 0]
            for hour, kind, n, cents in zip(*(new[c].tolist() for c in ("hour", "kind", "n_rows", "cents")), strict=True):
                n0, cents0, n1, cents1, published = panes.get((hour, kind), (0, 0, 0, 0, False))
                panes[hour, kind] = n0, cents0, n1 + n, cents1 + cents, published
        if mark:
            records, panes = self.ended(panes, *mark)
            if records:
                yield pd.DataFrame(records, columns=["batch", "hour", "kind", "n_rows", "cents", "record"])
        if panes:
            self.open.put([(*pane, *rest) for pane, rest in panes.items()])
        else:
            self.open.clear()

    def ended(self, panes: dict, watermark: int, last: int) -> tuple[list[tuple], dict]:
        """What the end of the batch publishes and revises, and the panes that stay open."""
        records, kept = [], {}
        for (hour, kind), (n0, cents0, n, cents, published) in panes.items():
            now, out = (n0 + n, cents0 + cents), []
            if not published:
                if watermark >= hour + 1 + self.due:
                    out, published = [(*now, "emit")], True
                elif last:
                    out = [(*now, "final")]
            elif n:
                out = [(n0, cents0, "retract"), (*now, "replace")]
            records += [(self.batch, hour, kind, *x) for x in out]
            if not last and watermark < hour + 1 + self.closed:
                kept[hour, kind] = (*now, 0, 0, published)
        return records, kept

    def close(self) -> None:
        pass


def revised_panes(rows: DataFrame, batches: int, *, due: int = DUE, closed: int = CLOSED, shards: int = SHARDS, files_per_trigger: int | None = None) -> DataFrame:
    """Records ``batch, hour, click_id, n_rows, cents, record, kind`` of rows ``batch, hour, kind, click_id, cents``.

    ``batch`` runs from 0 to ``batches`` - 1; ``hour`` counts since 1970 and may
    be negative; no column but ``click_id`` may be null. The watermark of a batch
    is the largest hour of those before; a pane (kind and hour) is due so many
    hours after its end, and closed so many. Rows of closed panes are ``late``
    (with their own id, as 1 row); other records have -1 for an id: ``emit`` and
    ``final`` publish a pane, ``retract`` and ``replace`` are its old and new
    totals. Rows are taken as they are: repeated ones count again. Without any
    rows there are no records.

    The batches are written to a new folder in the shared one and fed in order to
    the query, which is started anew for each on one checkpoint. ``files_per_trigger``
    cuts batches into micro-batches (the records stay the same); then files of a
    batch and its punctuation must differ in their times, which the store's clock
    has to tell apart. The driver sees a number a batch.
    """
    spark = rows.sparkSession
    common.prepare(spark)
    # The operator goes along as it is: the driver's worker, which sets up its state, doesn't see files sent to executors.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    root = common.new_path(spark, "panes")
    shard = F.pmod(F.xxhash64("hour", "kind"), F.lit(shards)).cast("int")
    zero = F.lit(0)
    rows = rows.select(F.col("batch").cast("int"), shard.alias("shard"), *(F.col(c).cast(t).alias(c) for c, t in (("hour", "long"), ("kind", "string"), ("click_id", "long"), ("cents", "long"))), zero.alias("mark"), zero.cast("long").alias("watermark"), zero.alias("last"))
    rows.write.partitionBy("batch").parquet(f"{root}/batches")
    highest = dict(spark.read.schema(f"{_ROWS}, batch int").parquet(f"{root}/batches").groupBy("batch").agg(F.max("hour")).collect())  # a row a batch
    watermark = NEVER
    with settings(spark, _SETTINGS):
        for batch in range(batches):
            feed(spark, root, batch, watermark, batch == batches - 1, due, closed, shards, files_per_trigger)
            watermark = max(watermark, highest.get(batch, NEVER))
    return spark.read.schema("batch bigint, hour bigint, click_id bigint, n_rows bigint, cents bigint, record string, kind string").parquet(f"{root}/records")


def feed(spark: SparkSession, root: str, batch: int, watermark: int, last: bool, due: int, closed: int, shards: int, files_per_trigger: int | None) -> None:
    """Hands the batch over, ends it by its punctuation, and runs the query over it."""
    none = F.lit(None)
    mark = spark.range(0, shards, 1, 1).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("hour"), F.lit("").alias("kind"), none.cast("long").alias("click_id"), F.lit(0).cast("long").alias("cents"), F.lit(1).alias("mark"), F.lit(watermark).cast("long").alias("watermark"), F.lit(int(last)).alias("last"))
    folder = f"{root}/fed"
    spark.read.schema(f"{_ROWS}, batch int").parquet(f"{root}/batches").filter(F.col("batch") == batch).drop("batch").write.mode("append").parquet(folder)
    mark.write.mode("append").parquet(folder)
    source = spark.readStream.schema(_ROWS)
    if files_per_trigger:
        source = source.option("maxFilesPerTrigger", files_per_trigger)
    rows = source.parquet(folder)
    is_late = (F.col("mark") == 0) & (F.col("hour") + 1 + closed <= watermark)
    late = rows.filter(is_late).select(F.lit(batch).cast("long").alias("batch"), "hour", "click_id", F.lit(1).cast("long").alias("n_rows"), "cents", F.lit("late").alias("record"), "kind")
    panes = rows.filter(~is_late).select("shard", "hour", "kind", "cents", "mark", "watermark", "last").mapInPandas(sums, _SUMS)
    records = panes.groupBy("shard").transformWithStateInPandas(Shard(batch, due, closed), _RECORDS, "Append", "None")
    records = records.select("batch", "hour", F.lit(-1).cast("long").alias("click_id"), "n_rows", "cents", "record", "kind")
    out = records.union(late).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    out.option("path", f"{root}/records").option("checkpointLocation", f"{root}/checkpoint").start().awaitTermination()


def click_batches(clicks: DataFrame, batches: int = 10) -> DataFrame:
    """``batch, hour, kind, click_id, cents`` of clicks, folded into so many days, some held back for some batches.

    Rows without ``ts`` are dropped. Of rows with one id the least (by
    ``arrived_at``, ``ts``, ``kind``, ``value``) counts; rows without an id count
    once if they are equal. Without ``arrived_at`` the day of ``ts`` counts;
    a value that is no number or beyond 64 bits gives 0 cents.
    """
    c = clicks.filter(clicks["ts"].isNotNull()).select("click_id", F.struct(F.coalesce("arrived_at", "ts").alias("arrived_at"), "ts", "kind", "value").alias("r"))
    once = c.groupBy("click_id", F.when(F.col("click_id").isNull(), F.xxhash64("r")).alias("__null")).agg(F.min("r").alias("r")).select("click_id", "r.*")
    day = lambda x: F.unix_date(F.to_date(x))
    q = F.pmod(day("arrived_at"), F.lit(batches))
    held = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit("")).cast("binary")) % 30 - 23)
    hour = (day("ts") - day("arrived_at") + q).cast("long") * 24 + F.hour("ts")
    cents = F.floor(100 * F.col("value").cast("double") + 0.5)
    sound = F.abs(F.col("value").cast("double")) < 9e16  # not for NaN, which is the largest
    return once.select(F.least(F.lit(batches - 1), q + held).cast("int").alias("batch"), hour.alias("hour"), F.coalesce("kind", F.lit("none")).alias("kind"), "click_id", F.when(sound, cents).otherwise(0).cast("long").alias("cents"))


def op13_window_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revised_panes(click_batches(common.read(spark, sf_dir, "clicks")), 10)


OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i AS n, i AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE k = 8),
once AS (
  SELECT click_id, min(struct_pack(arrived_at := coalesce(arrived_at, ts), ts := ts, kind := kind, value := value)) AS r
  FROM clicks WHERE ts IS NOT NULL GROUP BY click_id),
hashed AS (
  SELECT click_id, r.ts AS ts, coalesce(r.kind, 'none') AS kind, r.value AS value, date_diff('day', DATE '1970-01-01', CAST(r.arrived_at AS DATE)) AS d,
         xor(list_reduce(list_transform(string_split(CAST(click_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM once, crc),
ev AS (
  SELECT click_id, kind, least(9, d % 10 + greatest(0, h % 30 - 23)) AS batch,
         (date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) - d + d % 10) * 24 + extract('hour' FROM ts) AS hour,
         CAST(coalesce(floor(100 * value + 0.5), 0) AS BIGINT) AS cents
  FROM hashed),
marks AS (SELECT b AS batch, (SELECT max(hour) FROM ev WHERE ev.batch < b) AS w FROM range(10) r(b)),
placed AS (SELECT ev.*, coalesce(hour + 49 <= w, false) AS late FROM ev JOIN marks USING (batch)),
deltas AS (SELECT batch, hour, kind, count(*) AS n, sum(cents) AS c FROM placed WHERE NOT late GROUP BY ALL),
panes AS (SELECT hour, kind, min(batch) AS since FROM deltas GROUP BY ALL),
steps AS (
  SELECT p.hour, p.kind, m.batch, coalesce(d.n, 0) AS n, coalesce(d.c, 0) AS c, coalesce(m.w >= p.hour + 13, false) AS due
  FROM panes p JOIN marks m ON m.batch >= p.since LEFT JOIN deltas d ON d.hour = p.hour AND d.kind = p.kind AND d.batch = m.batch),
run AS (
  SELECT *, sum(n) OVER w AS total_n, sum(c) OVER w AS total_c, min(CASE WHEN due THEN batch END) OVER (PARTITION BY hour, kind) AS emitted
  FROM steps WINDOW w AS (PARTITION BY hour, kind ORDER BY batch)),
records AS (
  SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM placed WHERE late
  UNION ALL SELECT batch, hour, -1, total_n, total_c, 'emit', kind FROM run WHERE batch = emitted
  UNION ALL SELECT batch, hour, -1, total_n - n, total_c - c, 'retract', kind FROM run WHERE batch > emitted AND n > 0
  UNION ALL SELECT batch, hour, -1, total_n, total_c, 'replace', kind FROM run WHERE batch > emitted AND n > 0
  UNION ALL SELECT batch, hour, -1, total_n, total_c, 'final', kind FROM run WHERE emitted IS NULL AND batch = 9)
SELECT CAST(batch AS BIGINT) AS batch, CAST(hour AS BIGINT) AS hour, CAST(click_id AS BIGINT) AS click_id, CAST(n_rows AS BIGINT) AS n_rows,
       CAST(cents AS BIGINT) AS cents, record, kind FROM records
"""
