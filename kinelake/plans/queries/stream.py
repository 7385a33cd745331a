"""State of online loops: batch twins, and streams run to their end."""

from pyspark.sql import functions as F

from kinelake.operators import windows
from kinelake.plans.queries.aggregate import GRID
from kinelake.plans.registry import query, r6, table, traj
from kinelake.sources import shared
from kinelake.streaming import brokers as B
from kinelake.streaming import sessions as S


def steps(spark, d):
    return windows.action_chunks(traj(spark, d), 8, action="value").withColumnRenamed("episode", "session")


BROKER = "b AS (SELECT episode, t, t % {h} AS position, t - t % {h} AS chunk_t FROM traj), n AS (SELECT episode, max(t) AS last FROM traj GROUP BY 1)"


@query("WITH {traj}, " + BROKER.replace("{h}", "5") + " SELECT b.episode AS session, b.t, position, position = 0 AS infers, chunk_t, x.value AS action FROM b JOIN n USING (episode) JOIN traj x ON x.episode = b.episode AND x.t = least(chunk_t + position, last)")
def stm1_broker(spark, d):
    return S.broker_actions(steps(spark, d), 5).select("session", "t", "position", "infers", "chunk_t", "action")


@query("WITH {traj}, " + BROKER.replace("{h}", "3") + " SELECT b.episode AS session, b.t, x.value AS action FROM b JOIN n USING (episode) JOIN traj x ON x.episode = b.episode AND x.t = least(chunk_t + position, last)")
def stm2_stm3_replanned(spark, d):
    return S.replanned(steps(spark, d), 3).select("session", "t", "action")


@query("WITH {traj} SELECT episode AS session, t FROM traj WHERE t < 40 AND t <= coalesce((SELECT min(t) FROM traj b WHERE b.episode = traj.episode AND b.k = 99), 1000000)")
def stm4_limited(spark, d):
    return S.limited(traj(spark, d).withColumnRenamed("episode", "session").withColumn("done", F.col("k") == 99), 40, "done").select("session", "t")


@query("WITH {traj} SELECT episode AS session, t, value AS total, coalesce(lag(value) OVER (PARTITION BY episode ORDER BY t), -1) AS prev_total FROM traj")
def stm6_previous_total(spark, d):
    r = traj(spark, d).select(F.col("episode").alias("session"), "t", F.col("value").alias("total"))
    return S.previous_total(r).fillna(-1.0)


@query("WITH {traj} SELECT episode, t FROM traj WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = traj.event_id AND e.event_id % 3 = 0)")
def stm8_incremental(spark, d):
    from kinelake.operators.filters import not_done

    state = shared.staged(table(spark, d, "events").filter("event_id % 3 = 0").select("event_id"), "done")
    return not_done(traj(spark, d), state, "event_id").select("episode", "t")


@query("WITH {traj} SELECT episode, t FROM traj WHERE t >= 10")
def stm9_settled(spark, d):
    return S.settled(traj(spark, d)).select("episode", "t")


def _stream(spark, df, name):
    path = shared.new_path(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


@query("WITH {traj} SELECT episode AS session, t, t % 5 AS position, t % 5 = 0 AS infers FROM traj")
def stm1_stream_broker(spark, d):
    """The broker with state over a stream, run until all input is used."""
    stream = _stream(spark, traj(spark, d).select(F.col("episode").alias("session"), "t"), "steps")
    path = shared.new_path(spark, "brokered")
    q = S.stream_broker(stream, 5).writeStream.format("parquet").option("path", path).option("checkpointLocation", shared.new_path(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("session bigint, t bigint, position bigint, infers boolean").parquet(path)


@query("WITH {traj} SELECT episode AS session, t, (t + episode % 5) % 5 AS position, (t + episode % 5) % 5 = 0 AS infers FROM traj")
def stm1_session_broker(spark, d):
    """Sessions that go on from a table, over a stream in event time; a last stamp lets all that waits go."""
    steps = traj(spark, d).select(F.col("episode").alias("session"), "t", F.col("ts").cast("timestamp").alias("ts"))
    begun = shared.staged(steps.select("session").distinct().withColumn("n", F.col("session") % 5), "begun")
    path, out, state = (shared.new_path(spark, x) for x in ("steps", "brokered", "state"))
    steps.write.parquet(path)
    end = steps.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(-1).cast("long").alias("session"), F.lit(0).cast("long").alias("t"), "ts")

    def run():
        stream = spark.readStream.schema(steps.schema).parquet(path)
        q = B.session_broker(stream, 5, idle_ms=10**12, initial=begun)
        q.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    before = spark.conf.get(B.STATE_STORE[0])
    spark.conf.set(*B.STATE_STORE)
    try:
        run()
        end.write.mode("append").parquet(path)
        run()
    finally:
        spark.conf.set(B.STATE_STORE[0], before)
    return spark.read.schema("session bigint, t bigint, position bigint, infers boolean").parquet(out).filter("session >= 0")


@query("WITH {traj} SELECT 'value' AS key, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM traj")
def stm5_stm7_stream_stats(spark, d):
    """Statistics of a stream, merged after each micro-batch."""
    values = traj(spark, d).select(F.lit("value").alias("key"), F.lit(0).cast("long").alias("dim"), "value")
    stats = S.StreamStats()
    q = S.with_hooks(_stream(spark, values, "values"), stats.update).option("checkpointLocation", shared.new_path(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    n, mean, std = stats.parts["value", 0]
    return spark.createDataFrame([("value", n, round(mean, 6), round(std, 6))], "key string, n bigint, mean double, std double")


@query("WITH {traj}, l AS (SELECT 'value' AS key, 0 AS dim, value AS v FROM traj), " + GRID)
def stm7_stream_quantiles(spark, d):
    """Quantiles over a stream of several micro-batches, merged after each, by two queries one after the other."""
    values = traj(spark, d).select(F.lit("value").alias("key"), F.lit(0).cast("long").alias("dim"), "value")
    path, state = shared.new_path(spark, "values"), shared.new_path(spark, "state")
    grids = S.StreamQuantiles(shared.new_path(spark, "grids"))
    for half in (0, 1):  # the second query goes on where the first has ended
        values.filter(F.pmod(F.xxhash64("value"), F.lit(2)) == half).repartition(2).write.mode("append").parquet(path)
        stream = spark.readStream.schema(values.schema).option("maxFilesPerTrigger", 1).parquet(path)
        S.with_hooks(stream, S.StreamQuantiles(grids.path).update).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return grids.quantiles(spark, {"q01": 0.01, "q99": 0.99}).withColumns({"q01": r6("q01"), "q99": r6("q99")})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def ext_windowed_counts(spark, d):
    """Extension: event-time windows; as a batch every window is complete."""
    c = S.windowed_counts(table(spark, d, "events").select("ts", "event_type", "value"))
    return c.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("total").alias("total"))
