"""Sources and sinks: what is written is read again and compared."""

from pyspark.sql import functions as F

from kinelake.operators import aggregates, windows
from kinelake.plans.queries.aggregate import SHARDS, action_values, shards, sums
from kinelake.plans.queries.window import KEPT, ORDER, episode_order, ranges
from kinelake.plans.registry import exploded, long, query, table, traj
from kinelake.sources import readers, shared, sinks


@query("WITH {traj} SELECT episode, t, value, coalesce(lead(value, 2) OVER w, -1) AS ahead, round(2 / 15.0, 6) AS seconds FROM traj WINDOW w AS (PARTITION BY episode ORDER BY t)")
def src1_src2_frames(spark, d):
    from kinelake.operators.joins import time_offset

    f = traj(spark, d).select("episode", "t", "value")
    return time_offset(f, 2, "value").select("episode", "t", "value", F.coalesce("ahead", F.lit(-1.0)).alias("ahead"), F.round(F.lit(2 / 15), 6).alias("seconds"))


@query("SELECT o_orderkey AS episode_index, o_orderpriority AS task, o_custkey AS length FROM orders")
def src3_json_lines(spark, d):
    o = table(spark, d, "orders")
    lines = o.select(F.to_json(F.struct(F.col("o_orderkey").alias("episode_index"), F.array("o_orderpriority").alias("tasks"), F.col("o_custkey").alias("length"))).alias("value"))
    path = shared.new_path(spark, "lines")
    lines.unionByName(spark.createDataFrame([("",), ("   ",)], "value string")).write.text(path)
    return readers.json_lines(spark, path, readers.EPISODES).select("episode_index", F.col("tasks")[0].alias("task"), "length")


@query("WITH {traj}, " + KEPT + " SELECT 'user' || episode AS key, s AS start, e - 2 AS \"end\" FROM kept")
def src4_snk_ranges(spark, d):
    lists = windows.range_lists(ranges(spark, d), traj(spark, d).select("episode").distinct())
    text = lists.select(F.to_json(F.create_map(F.concat(F.lit("user"), F.col("episode").cast("string")), F.col("ranges"))).alias("value"))
    path = shared.new_path(spark, "ranges")
    text.write.text(path)
    return readers.ranges(spark.read.text(path))


@query("WITH " + SHARDS + " SELECT suite, category, total, success FROM sums")
def src5_shards(spark, d):
    """Shards as files ``<suite>/<start>_<end>.json``, read and summed."""
    s = shards(spark, d).groupBy("suite", "shard").agg(F.map_from_entries(F.collect_list(F.struct("category", F.struct("total_count", "success_count")))).alias("m"))
    rows = s.select(F.concat_ws("/", "suite", F.concat((F.col("shard") * 100).cast("string"), F.lit("_"), (F.col("shard") * 100 + 100).cast("string"), F.lit(".json"))).alias("path"), F.to_json("m").alias("value"))
    return aggregates.suite_category_sums(readers.shards(shared.staged(rows, "shards")))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def src6_equal_lengths(spark, d):
    e = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("a"), F.collect_list("o_totalprice").alias("b"))
    return readers.equal_lengths(e, "a", "b").select("o_custkey", long(F.size("a")).alias("n"))


@query("WITH {traj} SELECT episode AS trajectory_id, t AS base_index FROM traj")
def src9_steps(spark, d):
    return shared.staged(traj(spark, d).select(F.col("episode").alias("trajectory_id"), F.col("t").alias("base_index")), "steps")


@query("SELECT event_id AS step, value FROM events")
def src10_snk8_recorded_steps(spark, d):
    from kinelake.operators.project import flatten

    e = table(spark, d, "events").select(F.concat(F.lit("step_"), F.col("event_id").cast("string")).alias("path"), F.struct(F.struct("value").alias("state")).alias("inputs"))
    return readers.recorded_steps(shared.staged(flatten(e), "steps")).select("step", F.col("`inputs/state/value`").alias("value"))


@query("""WITH h AS (SELECT i AS index, name, j AS pos, ('0x' || substr(md5(i || ':' || j || ':' || name), 1, 6))::BIGINT AS h
FROM range(64) a(i), (VALUES ('state', 8), ('tokens', 4), ('mask', 2)) v(name, n), range(8) b(j) WHERE j < n)
SELECT index, name, pos, CASE name WHEN 'state' THEN h / 8388608.0::DOUBLE - 1 WHEN 'tokens' THEN h % 2048 ELSE 0 END::DOUBLE AS v FROM h""")
def src11_fake_samples(spark, d):
    s = readers.fake_samples(spark, 64, {"state": ("float", 8), "tokens": ("int", 4), "mask": ("bool", 2)})
    parts = [exploded(s, name, "index").select("index", F.lit(name).alias("name"), "pos", F.col("v").cast("double")) for name in ("state", "tokens", "mask")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 1 WHEN event_type LIKE 'e%' OR event_type LIKE 'c%' THEN 2 ELSE -1 END::BIGINT AS expiry FROM events")
def src12_first_rule(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(readers.first_rule(F.col("event_type"), [("^error$", 1), ("^[ec]", 2)]), F.lit(-1)).cast("long").alias("expiry"))


@query("WITH {traj}, l AS (SELECT value AS v FROM traj) SELECT 'actions' AS key, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) >= 0 AS ok FROM l")
def snk1_norm_stats(spark, d):
    """Written as JSON and read again."""
    values = action_values(spark, d)
    path = shared.new_path(spark, "norm_stats.json")
    sinks.write_norm_stats(aggregates.norm_stats(values), path)
    s = sinks.read_norm_stats(spark, path)["actions"]
    return spark.createDataFrame([("actions", round(s["mean"][0], 6), round(s["std"][0], 6), s["q01"][0] <= s["q99"][0])], "key string, mean double, std double, ok boolean")


@query("WITH {traj}, " + ORDER + """, o AS (SELECT *, sum(length) OVER (ORDER BY new_episode) - length AS off FROM ord)
SELECT new_episode AS episode_index, t AS frame_index, (off + t)::BIGINT AS index, value, new_episode // 1000 AS chunk FROM traj JOIN o USING (episode)""")
def snk2_snk4_rewritten_frames(spark, d):
    order = aggregates.running_total(episode_order(spark, d), "new_episode", F.col("length"), "offset")
    numbers = order.select(F.col("episode").alias("old"), F.col("new_episode").alias("new"), "offset")
    f = traj(spark, d).select(F.col("episode").alias("episode_index"), F.col("t").alias("frame_index"), F.lit(0).cast("long").alias("index"), "value")
    root = shared.new_path(spark, "dataset")
    sinks.write_frames(sinks.renumbered(f, numbers), root)
    return readers.frames(spark, root).withColumn("chunk", sinks.chunk(F.col("episode_index")))


@query("WITH {traj} SELECT count(DISTINCT episode) AS total_episodes, count(*) AS total_frames, count(DISTINCT event_type) AS total_tasks, ceil(count(DISTINCT episode) / 1000.0)::BIGINT AS total_chunks, '0:' || count(DISTINCT episode) AS train FROM traj")
def snk3_metadata(spark, d):
    f = traj(spark, d)
    episodes = f.groupBy(F.col("episode").alias("episode_index")).agg(F.collect_set("event_type").alias("tasks"), F.count("*").alias("length"))
    tasks = f.select(F.col("event_type").alias("task")).distinct().withColumn("task_index", F.xxhash64("task"))
    root = shared.new_path(spark, "dataset")
    info = sinks.write_metadata(episodes, tasks, root)
    names = readers.episodes(spark, root).select(F.explode("tasks").alias("task")).distinct()
    assert readers.tasks(spark, root).join(names, "task").count() == info["total_tasks"]
    return spark.createDataFrame([(info["total_episodes"], info["total_frames"], info["total_tasks"], info["total_chunks"], info["splits"]["train"])], "total_episodes bigint, total_frames bigint, total_tasks bigint, total_chunks bigint, train string")


@query("SELECT o_orderkey, 'data/chunk-' || lpad((o_orderkey // 1000)::VARCHAR, 3, '0') || '/episode_' || lpad(o_orderkey::VARCHAR, 6, '0') || '.parquet' AS path FROM orders")
def snk4_paths(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sinks.data_path(F.col("o_orderkey")).alias("path"))


@query("WITH f AS (SELECT user_id, min(event_id) AS f FROM events GROUP BY 1), n AS (SELECT user_id, row_number() OVER (ORDER BY f) - 1 AS episode_index FROM f) SELECT event_id, episode_index, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_index FROM events JOIN n USING (user_id)")
def snk5_numbered_frames(spark, d):
    return sinks.numbered_frames(table(spark, d, "events").select("event_id", "user_id"), order="event_id", key="user_id").select("event_id", "episode_index", "frame_index")


@query("SELECT p_partkey * 7919 % 1000003 AS key, row_number() OVER (ORDER BY p_partkey * 7919 % 1000003) - 1 AS pos, p_retailprice AS v FROM part")
def snk7_positions(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") * 7919 % 1000003).alias("key"), F.col("p_retailprice").alias("v"))
    return shared.staged(aggregates.dense_positions(p, "key"), "cache").select("key", long("pos").alias("pos"), "v")


@query("SELECT (max(o_orderkey) + 1)::BIGINT AS next FROM orders")
def snk9_next_number(spark, d):
    n = table(spark, d, "orders").select(F.concat(F.lit("out_"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("name"))
    return sinks.next_number(n.unionByName(spark.createDataFrame([("other.txt",)], "name string")), r"^out_(\d+)\.mp4$")


@query("WITH " + SHARDS + ", c AS (SELECT category, sum(total)::BIGINT AS total, sum(success)::BIGINT AS success FROM sums GROUP BY 1) SELECT row_number() OVER (ORDER BY category) - 1 AS pos, category, total, success FROM c")
def snk10_summary(spark, d):
    kind = "struct<per_category:array<struct<category:string,total:bigint,success:bigint,micro:double,macro:double>>>"
    j = sinks.summary_json(sums(spark, d)).select(F.from_json("json", kind).alias("j"))
    rows = j.select(F.posexplode("j.per_category").alias("pos", "c"))
    return rows.select(long("pos").alias("pos"), "c.category", "c.total", "c.success")


@query("SELECT event_id, value AS ms FROM events")
def snk11_timings(spark, d):
    return shared.staged(table(spark, d, "events").select("event_id", F.col("value").alias("ms")), "timings")


@query("SELECT s_suppkey AS video, (s_suppkey % 2)::DOUBLE AS success, s_acctbal AS duration FROM supplier")
def snk12_csv(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 2).cast("double").alias("success"), F.col("s_acctbal").alias("duration"), F.concat(F.lit("video_"), F.col("s_suppkey").cast("string"), F.lit(".mp4")).alias("video_filename"))
    path = shared.new_path(spark, "csv")
    s.write.option("header", "true").csv(path)
    back = spark.read.option("header", "true").schema("success double, duration double, video_filename string").csv(path)
    return back.select(F.regexp_extract("video_filename", r"(\d+)", 1).cast("long").alias("video"), "success", "duration")


@query("SELECT doc_id, md5(hex(encode(text))) AS digest, strlen(text)::BIGINT AS n FROM documents")
def wire1_arrays(spark, d):
    """Arrays on the wire, packed and unpacked."""
    from kinelake.sources import wire

    shared.small_batches(spark)
    packed = table(spark, d, "documents").select("doc_id", wire.pack(F.encode("text", "UTF-8")).alias("w"))
    return packed.select("doc_id", wire.unpack(F.col("w")).alias("b")).select("doc_id", F.md5(F.hex("b")).alias("digest"), long(F.octet_length("b")).alias("n"))
