"""Robots' configurations, functions of episodes, and sessions with state."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinelake.operators import trajectories, windows
from kinelake.plans import robots
from kinelake.sources import shared
from kinelake.streaming import brokers, sessions


def sample(spark, **more):
    cols = {"image": F.unhex(F.lit("0102")), "wrist_image": F.unhex(F.lit("03")), "state": F.array(*(F.lit(float(i)) for i in range(8))), "actions": F.array(F.array(*(F.lit(float(i)) for i in range(7)))), "prompt": F.lit("Pick_up\n"), **more}
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items()))


def test_libero_inputs_and_masks(spark):
    for model, right in (("flow", False), ("fast", True)):
        r = sample(spark).transform(robots.robot_config("libero", model, {}, delta=False, most_tokens=12).training()).first()
        assert r["image"]["base_0_rgb"] == b"\x01\x02" and r["image"]["left_wrist_0_rgb"] == b"\x03" and r["image"]["right_wrist_0_rgb"] == b"\x00\x00"
        assert r["image_mask"] == {"base_0_rgb": True, "left_wrist_0_rgb": True, "right_wrist_0_rgb": right}
        assert len(r["tokens"]) == len(r["token_mask"]) == 12 and sum(r["token_mask"]) == min(12, len(r["prompt_text"].encode()))
        assert len(r["state"]) == (8 if model == "fast" else 32)


def test_fast_actions_are_a_postfix(spark):
    config = robots.robot_config("libero", "fast", {}, delta=False, tokenizer="bytes", most_tokens=400, postfix=lambda a: F.transform(a[0], lambda v: v.cast("long") + 1000))
    r = sample(spark).transform(config.training()).first()
    n = len(r["prompt_text"].encode())
    assert r["tokens"][n : n + 7] == [1000 + i for i in range(7)] and r["ar_mask"] == r["loss_mask"] == [0] * n + [1] * 7 + [0] * (393 - n)
    without = sample(spark).drop("actions").transform(config.training()).first()  # as at inference
    assert sum(without["loss_mask"]) == 0 and "actions" not in without.asDict()


def test_inference_starts_from_observations(spark):
    s = sample(spark).select(F.struct("image", "wrist_image", "state").alias("observation"))
    config = robots.robot_config("libero", "flow", {}, prompt="do it", repack={"observation": "observation"})
    assert s.transform(config.inference_inputs("do it")).first()["prompt_text"].startswith("do it")


def test_aloha_cameras(spark):
    image = F.array(F.array(F.lit(1), F.lit(2)))
    s = spark.range(1).select(F.struct(F.struct(image.alias("cam_high"), image.alias("cam_right_wrist")).alias("images"), F.array(*(F.lit(0.02 * i) for i in range(14))).alias("state")).alias("o"))
    config = robots.robot_config("aloha", "flow", {}, prompt="x", repack={"images": "o/images", "state": "o/state"})
    r = s.transform(config.training()).first()
    assert r["image_mask"] == {"base_0_rgb": True, "left_wrist_0_rgb": False, "right_wrist_0_rgb": True} and r["image"]["left_wrist_0_rgb"] == [[0, 0]]
    bad = spark.range(1).select(F.struct(F.lit(1).alias("cam_high"), F.lit(1).alias("cam_feet")).alias("images"), F.array(F.lit(0.0)).alias("state"))
    with pytest.raises(ValueError, match="cam_feet"):
        bad.transform(robots.aloha_inputs())
    with pytest.raises(KeyError):
        robots.robot_config("tractor", "flow", {})
    with pytest.raises(KeyError, match="wrist_image"):
        sample(spark).drop("wrist_image").transform(robots.robot_config("libero", "flow", {}).training())


def test_episodes_are_streams(spark):
    """Small batches, a null episode, and a function that stops early; none of it holds an episode."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        f = spark.range(100).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("episode"), F.col("id").alias("t"), (F.col("id") * 1.5).alias("value")).repartition(3)
        got = trajectories.trajectory_map(f, trajectories.chunker(10, "value"), "episode long, t long, chunk array<double>")
        want = windows.action_chunks(f, 10, action="value").select("episode", "t", "chunk")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

        def first_two(key, batches):
            n = 0
            for b in batches:
                n += b.num_rows
                if n >= 10:
                    break
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([n], pa.int64())], ["episode", "n"])

        stopped = {r["episode"]: r["n"] for r in trajectories.trajectory_map(f, first_two, "episode long, n long").collect()}
        assert set(stopped) == {None, 1, 2} and all(10 <= n < 34 for n in stopped.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert trajectories.trajectory_map(f.limit(0), first_two, "episode long, n long").count() == 0


def test_sessions_wait_go_on_and_end(spark):
    """Late steps keep their order, a restart goes on in mid-chunk, an idle session begins anew, and a table gives where to begin."""
    path, out, state = (shared.new_path(spark, x) for x in ("steps", "out", "state"))
    spark.conf.set(*brokers.STATE_STORE)
    begun = spark.createDataFrame([("b", 3)], "session string, n long")

    def run(rows):
        spark.createDataFrame(rows, "session string, t long, s long").select("session", "t", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema("session string, t long, ts timestamp").parquet(path)
        q = brokers.session_broker(stream, 4, late="60 seconds", idle_ms=1_000_000, initial=begun)
        q.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return {(r["session"], r["t"]): r["position"] for r in spark.read.schema("session string, t long, position long, infers boolean").parquet(out).collect()}

    try:
        run([("a", 0, 1000), ("a", 2, 1020), ("b", 0, 1000)])
        run([("a", 1, 1010), ("z", 0, 2000)])  # late, but within the watermark
        got = run([("a", 3, 2010), ("z", 1, 2100)])
        assert {k: got[k] for k in (("a", 0), ("a", 1), ("a", 2), ("b", 0))} == {("a", 0): 0, ("a", 1): 1, ("a", 2): 2, ("b", 0): 3}
        run([("z", 2, 4000)])
        got = run([("a", 4, 4001), ("z", 3, 9000), ("z", 4, 9001)])
        assert got["a", 3] == 3  # after a restart
        got = run([("z", 5, 20000)])
        assert got["a", 4] == 0  # forgotten after 1000 seconds
    finally:
        spark.conf.unset(brokers.STATE_STORE[0])


def test_sessions_share_the_store(spark, monkeypatch):
    """Timers are those of shards, not of sessions; the null session, long waits and beginnings are as in the batch form."""
    monkeypatch.setattr(brokers, "ROW_STEPS", 2)
    path, out, state = (shared.new_path(spark, x) for x in ("steps", "out", "state"))
    steps = spark.range(1000).select(F.expr("nullif(id % 200, 7) + 9007199254740993").alias("session"), F.expr("id DIV 200").alias("t"), F.timestamp_seconds(F.expr("1000 + (id * 37) % 5 + 10 * (id DIV 200)")).alias("ts"))
    begun = steps.filter("t = 0 AND session % 2 = 0 OR session IS NULL").select("session", F.lit(3).alias("n")).distinct()
    end = spark.sql("SELECT -1L AS session, 0L AS t, timestamp_seconds(9000) AS ts")
    timers = []
    spark.conf.set(*brokers.STATE_STORE)
    try:
        for rows in (steps.filter("t > 0"), steps.filter("t = 0"), end):
            rows.write.mode("append").parquet(path)
            stream = spark.readStream.schema(steps.schema).parquet(path)
            q = brokers.session_broker(stream, 4, idle_ms=10**12, initial=begun, shards=16).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            q.awaitTermination()
            timers += [o["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress for o in p["stateOperators"]]
    finally:
        spark.conf.unset(brokers.STATE_STORE[0])
    got = spark.read.schema("session long, t long, position long, infers boolean").parquet(out)
    want = sessions.broker_positions(steps, 4).join(begun.select(F.col("session").alias("s"), "n"), F.col("session").eqNullSafe(F.col("s")), "left")
    want = want.select("session", "t", F.pmod(F.col("position") + F.coalesce("n", F.lit(0)), F.lit(4)).alias("position")).withColumn("infers", F.col("position") == 0)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert 0 < max(timers) <= 16


def test_steps_of_the_watermarks_millisecond_wait(spark):
    path, out, state = (shared.new_path(spark, x) for x in ("steps", "out", "state"))
    spark.conf.set(*brokers.STATE_STORE)
    try:
        for rows in ([("a", 1, 1000_000_400), ("b", 0, 999_000_000), ("z", 0, 1060_000_000)], [("a", 0, 1000_000_200)], [("z", 1, 9000_000_000)]):
            spark.createDataFrame(rows, "session string, t long, us long").select("session", "t", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(path)
            stream = spark.readStream.schema("session string, t long, ts timestamp").parquet(path)
            brokers.session_broker(stream, 4, late="60 seconds", shards=1).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(brokers.STATE_STORE[0])
    got = {(r["session"], r["t"]): r["position"] for r in spark.read.schema("session string, t long, position long, infers boolean").parquet(out).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("b", 0): 0, ("z", 0): 0}


def test_batch_twin_agrees(spark):
    s = spark.createDataFrame([("a", i) for i in range(9)], "session string, t long")
    assert [r["position"] for r in sessions.broker_positions(s, 4).orderBy("t").collect()] == [0, 1, 2, 3, 0, 1, 2, 3, 0]
