"""Statistics and roll-ups over the test tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinelake.functions import vectors as V
from kinelake.operators import aggregates as A
from kinelake.operators import windows
from kinelake.plans.registry import long, query, r6, table, traj, vectors

ACTIONS = "a AS (SELECT episode, t, value AS v0, k::DOUBLE AS v1 FROM traj)"
LONG = ACTIONS + ", l AS (SELECT 'actions' AS key, 0 AS dim, v0 AS v FROM a UNION ALL SELECT 'actions', 1, v1 FROM a)"


def action_values(spark, d):
    return A.dimensions(traj(spark, d).select(F.array("value", F.col("k").cast("double")).alias("x")), {"actions": F.col("x")})


@query("WITH {traj}, " + LONG + " SELECT key, dim::BIGINT AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS low, max(v) AS high, count(*) AS n FROM l GROUP BY key, dim")
def agg1_agg3_moments(spark, d):
    return A.moments(action_values(spark, d)).withColumns({"mean": r6("mean"), "std": r6("std")})


QUANTILES = """b AS (SELECT key, dim, min(v) - 1e-10 AS low, max(v) + 1e-10 AS high, count(*) AS n FROM l GROUP BY key, dim),
h AS (SELECT key, dim, least(4999, floor((v - low) / ((high - low) / 5000))) AS bin, count(*) AS c FROM l JOIN b USING (key, dim) GROUP BY 1, 2, 3),
u AS (SELECT *, sum(c) OVER (PARTITION BY key, dim ORDER BY bin) AS upto FROM h),
q AS (SELECT key, dim, round(any_value(low) + min(CASE WHEN upto >= 0.01 * n THEN bin END) * any_value((high - low) / 5000), 6) AS q01,
round(any_value(low) + min(CASE WHEN upto >= 0.99 * n THEN bin END) * any_value((high - low) / 5000), 6) AS q99 FROM u JOIN b USING (key, dim) GROUP BY key, dim)"""


@query("WITH {traj}, " + LONG + ", " + QUANTILES + " SELECT key, dim::BIGINT AS dim, q01, q99 FROM q")
def agg2_histogram_quantiles(spark, d):
    return A.histogram_quantiles(action_values(spark, d), {"q01": 0.01, "q99": 0.99}).withColumns({"q01": r6("q01"), "q99": r6("q99")})


GRID = """r AS (SELECT key, dim, min(v) AS low, max(v) AS high FROM l GROUP BY key, dim),
e AS (SELECT *, (SELECT min(x) FROM range(-40, 20) g(x) WHERE floor(high / pow(2.0, x)) - floor(low / pow(2.0, x)) < 5000) AS e FROM r),
h AS (SELECT key, dim, e, low, floor(v / pow(2.0, e)) AS cell, count(*) AS c FROM l JOIN e USING (key, dim) WHERE v IS NOT NULL GROUP BY ALL),
u AS (SELECT *, sum(c) OVER (PARTITION BY key, dim ORDER BY cell) AS upto, sum(c) OVER (PARTITION BY key, dim) AS n FROM h)
SELECT key, dim::BIGINT AS dim, round(min(CASE WHEN upto >= 0.01 * n THEN greatest(low, cell * pow(2.0, e)) END), 6) AS q01, round(min(CASE WHEN upto >= 0.99 * n THEN greatest(low, cell * pow(2.0, e)) END), 6) AS q99 FROM u GROUP BY key, dim"""


@query("WITH {traj}, " + LONG + ", " + GRID)
def agg2_merged_quantiles(spark, d):
    """Histograms of parts by type of event, merged: as when data is added. Equal to that of the whole."""
    from kinelake.operators import quantiles as Q

    x = F.array("value", F.col("k").cast("double"))
    parts = [Q.grid_histogram(A.dimensions(traj(spark, d).filter(F.col("event_type") == t).select(x.alias("x")), {"actions": F.col("x")})) for t in ("click", "view", "error", "signup", "purchase")]
    merged = Q.merged_grids(reduce(DataFrame.unionByName, parts))
    return Q.grid_quantiles(merged, {"q01": 0.01, "q99": 0.99}).withColumns({"q01": r6("q01"), "q99": r6("q99")})


@query("WITH {traj}, n AS (SELECT episode, max(t) AS last FROM traj GROUP BY episode), rows AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM traj),\n"
       "kept AS (SELECT * FROM rows JOIN n USING (episode) WHERE pos < (SELECT count(*) FROM traj) // 64 * 64),\n"
       "c AS (SELECT b.value AS v0, b.k::DOUBLE AS v1 FROM kept a, range(4) k(k), traj b WHERE b.episode = a.episode AND b.t = least(a.t + k.k, a.last)),\n"
       "l AS (SELECT 'actions' AS key, 0 AS dim, v0 AS v FROM c UNION ALL SELECT 'actions', 1, v1 FROM c UNION ALL SELECT 'state', 0, k::DOUBLE FROM kept UNION ALL SELECT 'state', 1, value FROM kept UNION ALL SELECT 'state', 2, value - k FROM kept),\n" + QUANTILES + """
SELECT key, dim::BIGINT AS dim, round(mean, 6) AS mean, round(std, 6) AS std, q01, q99 FROM (SELECT key, dim, avg(v) AS mean, stddev_pop(v) AS std FROM l GROUP BY key, dim) JOIN q USING (key, dim)""")
def agg4_norm_stats_job(spark, d):
    """Whole batches of samples, both keys, moments and quantiles: the look-ahead is staged, as it is read several times."""
    from kinelake.operators.sampling import whole_batches
    from kinelake.plans.pipelines import compute_norm_stats
    from kinelake.sources.shared import staged

    k = F.col("k").cast("double")
    chunks = windows.action_chunks(traj(spark, d).withColumns({"state": F.array(k, "value", F.col("value") - k), "action": F.array("value", k)}), 4, out="actions")
    stats = compute_norm_stats(whole_batches(staged(chunks.select("event_id", "state", "actions"), "samples"), 64, "event_id"))
    rows = stats.select("key", F.posexplode(F.arrays_zip("mean", "std", "q01", "q99")).alias("dim", "s"))
    return rows.select("key", long("dim").alias("dim"), *(r6(f"s.{c}").alias(c) for c in ("mean", "std", "q01", "q99")))


@query("WITH {traj}, " + LONG + " SELECT key, dim::BIGINT AS dim, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS low, max(v) AS high, count(*)::BIGINT AS n FROM l GROUP BY key, dim")
def agg1_merged_moments(spark, d):
    """Statistics of parts by type of event, merged: as when data is added."""
    x = F.array("value", F.col("k").cast("double"))
    parts = [A.moments(A.dimensions(traj(spark, d).filter(F.col("event_type") == t).select(x.alias("x")), {"actions": F.col("x")})) for t in ("click", "view", "error", "signup", "purchase")]
    return A.merged_moments(reduce(DataFrame.unionByName, parts)).withColumns({"mean": r6("mean"), "std": r6("std")})


SHARDS = """shards AS (SELECT r_name AS suite, c_mktsegment AS category, c_custkey // 100 AS shard, count(*) AS total_count, count(*) FILTER (c_acctbal > 3000) AS success_count
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE NOT (r_name = 'ASIA' AND c_mktsegment = 'MACHINERY') GROUP BY 1, 2, 3
UNION ALL SELECT 'ASIA', 'MACHINERY', 0, 0, 0),
sums AS (SELECT suite, category, sum(total_count)::BIGINT AS total, sum(success_count)::BIGINT AS success FROM shards WHERE category <> 'overall' GROUP BY 1, 2)"""


def shards(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.filter("NOT (r_name = 'ASIA' AND c_mktsegment = 'MACHINERY')")
    found = rows.groupBy(F.col("r_name").alias("suite"), F.col("c_mktsegment").alias("category"), F.floor(F.col("c_custkey") / 100).alias("shard")).agg(F.count("*").alias("total_count"), F.count_if(F.col("c_acctbal") > 3000).alias("success_count"))
    empty = spark.createDataFrame([("ASIA", "MACHINERY", 0, 0, 0)], found.schema)
    return found.unionByName(empty)


def sums(spark, d):
    return A.suite_category_sums(shards(spark, d))


@query("WITH " + SHARDS + " SELECT * FROM sums")
def agg5_suite_category(spark, d):
    return sums(spark, d)


@query("WITH " + SHARDS + " SELECT suite, sum(total)::BIGINT AS total, sum(success)::BIGINT AS success, round(CASE WHEN sum(total) > 0 THEN sum(success) / sum(total) ELSE 0 END, 6) AS rate FROM sums GROUP BY ROLLUP (suite)")
def agg6_agg7_overall(spark, d):
    return A.suite_overall(sums(spark, d)).withColumn("rate", r6("rate"))


@query("WITH " + SHARDS + """ SELECT category, sum(total)::BIGINT AS total, sum(success)::BIGINT AS success, round(sum(success) / sum(total), 6) AS micro,
round(coalesce(avg(CASE WHEN total > 0 THEN success / total END), 0), 6) AS macro, count(CASE WHEN total > 0 THEN 1 END) AS num_suites FROM sums GROUP BY category""")
def agg8_micro_macro(spark, d):
    return A.category_summary(sums(spark, d)).select("category", "total", "success", r6("micro").alias("micro"), r6("macro").alias("macro"), "num_suites")


@query("WITH " + SHARDS + " SELECT category, suite, round(CASE WHEN total > 0 THEN success / total ELSE 0.0 END, 6) AS rate FROM sums")
def agg9_per_suite(spark, d):
    return A.category_summary(sums(spark, d)).select("category", F.explode("per_suite").alias("suite", "rate")).withColumn("rate", r6("rate"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, " + ", ".join(f"round(quantile_cont(value, 0.{p}), 6) AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + " FROM events GROUP BY 1")
def agg10_latency_quantiles(spark, d):
    q = A.latency_quantiles(table(spark, d, "events"), "event_type", "value")
    return q.select("event_type", *(r6(c).alias(c) for c in q.columns[1:]))


@query("SELECT event_id % 5003 AS grp, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS low, max(value) AS high, round(coalesce(stddev_samp(value), 0), 6) AS std, round(1000 / avg(value), 6) AS hz FROM events GROUP BY 1")
def agg11_latency_summary(spark, d):
    q = A.latency_summary(table(spark, d, "events").select((F.col("event_id") % 5003).alias("grp"), "value"), "grp", "value")
    return q.withColumns({c: r6(c) for c in ("mean", "median", "std", "hz")})


@query("SELECT event_type, r::BIGINT AS replan, round(16.0::DOUBLE / r / (avg(value) / 1000), 6) AS rate FROM events, (VALUES (1), (5), (10), (16)) v(r) GROUP BY event_type, r")
def agg12_control_rates(spark, d):
    means = table(spark, d, "events").groupBy("event_type").agg((F.avg("value") / 1000).alias("mean_s"))
    return A.control_rates(means, 16).select("event_type", "replan", r6("rate").alias("rate"))


@query("SELECT ceil(event_id / 100.0)::BIGINT AS \"window\", count(*) AS steps, round(avg(coalesce(CASE WHEN event_id % 2 = 0 THEN value END, 0)), 6) AS loss, round(avg(CASE WHEN event_id % 3 = 0 THEN value END), 6) AS grad_norm FROM events GROUP BY 1")
def agg13_logged_means(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("step"), F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("loss"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("grad_norm"))
    return A.logged_means(e, 100, ["loss"], ["grad_norm"]).withColumns({"loss": r6("loss"), "grad_norm": r6("grad_norm")})


KEYED = "rows AS (SELECT l_partkey AS key, l_orderkey AS file, l_linenumber AS pos, l_quantity AS q, l_extendedprice AS price, l_suppkey AS supp FROM lineitem)"


@query("WITH " + KEYED + ", w AS (SELECT key, file, price FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file DESC, pos DESC, price DESC, q DESC, supp DESC) AS r FROM rows) WHERE r = 1) SELECT key, file, price, row_number() OVER (ORDER BY key) - 1 AS pos FROM w")
def agg14_last_wins_positions(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("at"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("q"), F.col("l_suppkey").alias("supp"))
    last = A.last_wins(rows, "key", "file", "at", "price", "q", "supp").select("key", "file", "price")
    return A.dense_positions(last, "key").select("key", "file", "price", long("pos").alias("pos"))


@query("WITH " + KEYED + " SELECT key, file, price FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file, pos, price, q, supp) AS r FROM rows) WHERE r = 1")
def agg15_first_seen(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("at"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("q"), F.col("l_suppkey").alias("supp"))
    return A.first_seen(rows, "key", ["file", "price"], "file", "at", "price", "q", "supp")


@query("WITH {traj} SELECT count(*) AS total_frames, count(DISTINCT episode) AS total_episodes, count(DISTINCT event_type) AS total_tasks, ceil(count(DISTINCT episode) / 100.0)::BIGINT AS total_chunks FROM traj")
def agg16_totals(spark, d):
    return A.dataset_totals(traj(spark, d), task="event_type", size=100)


@query("WITH {traj} SELECT episode, count(*) AS length FROM traj GROUP BY 1")
def agg17_checked_lengths(spark, d):
    f = traj(spark, d)
    return A.checked_lengths(f.groupBy("episode").agg((F.max("t") + 1).alias("length")), f)


@query("SELECT c_mktsegment AS task, count(*) AS episodes, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0 END), 6) AS rate FROM customer GROUP BY 1")
def agg18_success_rates(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("task")).agg(F.count("*").alias("episodes"), r6(F.avg((F.col("c_acctbal") > 0).cast("double"))).alias("rate"))


@query("SELECT n_name AS category, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000 GROUP BY 1")
def agg19_dense_counts(spark, d):
    n = table(spark, d, "nation")
    counts = table(spark, d, "supplier").filter("s_acctbal > 5000").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("category")).agg(F.count("*").alias("n"))
    return A.dense_counts(n.select(F.col("n_name").alias("category")), counts)


PAIRS = "p AS (SELECT a.vec_id, a.label, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"
NORMS = """n AS (SELECT label, list_sum(list_transform(range(1, 65), lambda i: x[i] * y[i])) AS xy,
greatest(sqrt(list_sum(list_transform(x, lambda v: v * v))), 1e-6) AS nx, 2 * greatest(sqrt(list_sum(list_transform(y, lambda v: v * v))), 1e-6) AS ny FROM p)"""


def pairs(spark, d):
    v = vectors(spark, d)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("x", lambda a: a * 2.0).alias("y")), "vec_id")


@query("WITH " + PAIRS + ", " + NORMS + " SELECT label::BIGINT AS label, round(avg(2 * xy / nx / ny), 6) AS cos_sim, round(avg(nx / ny), 6) AS norm_ratio, round(stddev_samp(ln(nx / ny)), 6) AS norm_log_std FROM n GROUP BY 1")
def agg20_prediction_quality(spark, d):
    p = pairs(spark, d)
    ratio = F.greatest(V.norm(F.col("x")), F.lit(V.EPS)) / F.greatest(V.norm(F.col("y")), F.lit(V.EPS))
    return p.groupBy("label").agg(r6(F.avg(V.cosine(F.col("x"), F.col("y")))).alias("cos_sim"), r6(F.avg(ratio)).alias("norm_ratio"), r6(F.stddev_samp(F.log(ratio))).alias("norm_log_std"))


@query("""WITH w AS (SELECT vec_id % 5 AS batch, vec_id // 5 % 4 AS head, vec_id // 20 % 5 AS query, i - 1 AS key, embedding[i]::DOUBLE AS weight FROM embeddings, range(1, 65) r(i)),
q AS (SELECT batch, query, key, avg(weight) AS w FROM w GROUP BY 1, 2, 3), k AS (SELECT batch, key, avg(w) AS w FROM q GROUP BY 1, 2)
SELECT batch, key // 16 AS camera, key % 16 // 4 AS row, key % 4 AS "column", round(w, 6) AS w FROM k""")
def agg21_attention_grid(spark, d):
    w = vectors(spark, d).select((F.col("vec_id") % 5).alias("batch"), F.floor(F.col("vec_id") / 5 % 4).alias("head"), F.floor(F.col("vec_id") / 20 % 5).alias("query"), F.posexplode("x").alias("key", "weight"))
    g = A.attention_grid(w, 4)
    return g.select("batch", *(long(c).alias(c) for c in ("camera", "row", "column")), r6("w").alias("w"))


@query("WITH RECURSIVE {traj}, e AS (SELECT episode, t, value AS ema FROM traj WHERE t = 0 UNION ALL SELECT e.episode, x.t, 0.9 * e.ema + 0.1 * x.value FROM e JOIN traj x ON x.episode = e.episode AND x.t = e.t + 1)\n"
       "SELECT episode, round(max_by(ema, t), 6) AS ema FROM e GROUP BY 1")
def agg22_moving_average(spark, d):
    seq = traj(spark, d).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s"))
    return seq.select("episode", r6(A.moving_average(F.col("s.value"), 0.9)).alias("ema"))


@query("SELECT event_type, round(sqrt(sum(value * value)), 6) AS norm FROM events GROUP BY 1")
def agg23_global_norm(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(r6(A.global_norm("value")).alias("norm"))


@query("WITH g AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events) SELECT user_id, round(avg(g), 3) AS mean_dt, round(1 / avg(g), 6) AS hz FROM g GROUP BY 1")
def agg24_mean_interval(spark, d):
    e = table(spark, d, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return A.mean_interval(e, "s", "user_id").select("user_id", F.round("mean_dt", 3).alias("mean_dt"), r6("hz").alias("hz"))
