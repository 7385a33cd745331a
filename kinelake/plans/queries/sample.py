"""Order, subsets, mixtures, batches over the test tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinelake.operators import sampling as S
from kinelake.operators.aggregates import category_rank, dense_positions
from kinelake.operators.scans import segmented_scan, total
from kinelake.plans.queries.window import ORDER, episode_order
from kinelake.plans.registry import long, query, table, traj, vectors

WEIGHTS = {"click": 0.4, "view": 0.3, "error": 0.15, "signup": 0.1, "purchase": 0.05}


def placed_events(spark, d):
    """Events with their place in their dataset; a dataset may hold most rows."""
    e = table(spark, d, "events").select(F.col("event_type").alias("dataset"), "event_id", F.lit(1).cast("long").alias("one"))
    return segmented_scan(e, ["dataset"], ["event_id"], {"pos": total("one")}).select("dataset", "event_id", F.coalesce("pos", F.lit(0).cast("long")).alias("pos"))


KEY = "(event_id * 7919 + 42 * 104729 + event_id % 97 * 15485863) % 2147483647"


@query("SELECT i AS episode, i AS back, n FROM (SELECT count(DISTINCT user_id) AS n FROM events), LATERAL (SELECT unnest(range(0, n)) AS i)")
def ord1_permutation(spark, d):
    """Every episode has one new place, and from there the way back; the places themselves are held against NumPy's in the tests."""
    n = traj(spark, d).select("episode").distinct().count()
    p = S.permutation(spark, n, 42)
    places = spark.range(n).select(F.col("id").alias("new_episode"))
    return places.join(p, "new_episode", "left").select("episode", F.col("episode").alias("back"), F.lit(n).cast("long").alias("n"))


@query("WITH {traj}, " + ORDER + ", n AS (SELECT count(*) AS n FROM ep) SELECT s AS subset, episode FROM ord, n, (VALUES ('full', 1.0), ('quarter', 0.25), ('twentieth', 0.05), ('hundredth', 0.01)) v(s, r) WHERE new_episode < greatest(1, round_even(n * r::DOUBLE, 0))")
def ord2_nested_subsets(spark, d):
    return S.nested_subsets(episode_order(spark, d), {"full": 1.0, "quarter": 0.25, "twentieth": 0.05, "hundredth": 0.01}).select("subset", "episode")


@query(f"SELECT event_id, {KEY} AS place FROM events")
def ord3_shuffled(spark, d):
    return S.shuffled(table(spark, d, "events"), "event_id", 42).select("event_id", S.shuffle_key(F.col("event_id"), 42).alias("place"))


@query("""WITH p AS (SELECT event_type AS dataset, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS size, 2 * count(*) OVER () AS total FROM events),
q AS (SELECT *, round_even(total * CASE dataset WHEN 'click' THEN 0.4 WHEN 'view' THEN 0.3 WHEN 'error' THEN 0.15 WHEN 'signup' THEN 0.1 ELSE 0.05 END::DOUBLE, 0)::BIGINT AS quota FROM p)
SELECT dataset, event_id, e AS epoch FROM q, LATERAL (SELECT unnest(range(0, ceil((quota - pos) / size)::BIGINT)) AS e) WHERE quota > pos""")
def ord4_quota_mixture(spark, d):
    e = placed_events(spark, d)
    return S.quota_mixture(e, WEIGHTS, 2 * e.count()).select("dataset", "event_id", "epoch")


@query("""WITH RECURSIVE q AS (SELECT [8, 6, 3, 2, 1] AS q, ['click', 'view', 'error', 'signup', 'purchase'] AS names),
turns AS (SELECT 0 AS n, [0, 0, 0, 0, 0] AS a, 0 AS pick UNION ALL
  SELECT n + 1, list_transform(a, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
    SELECT n, a, list_position(s, list_max(s)) AS p FROM (
      SELECT n, a, list_transform(a, lambda x, i: CASE WHEN x * 20 < q[i] * (n + 1) THEN q[i]::DOUBLE / (x + 1) ELSE -1.0 END) AS s FROM turns, q WHERE n < 20))),
slots AS (SELECT names[pick] AS dataset, n - 1 AS slot, q[pick] AS quota, row_number() OVER (PARTITION BY pick ORDER BY n) - 1 AS nth FROM turns, q WHERE n > 0),
p AS (SELECT event_type AS dataset, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS size, 2 * count(*) OVER () AS total FROM events),
k AS (SELECT dataset, event_id, e AS epoch, e * size + pos AS k, total FROM p, LATERAL (SELECT unnest(range(0, 2 * total // size + 1)) AS e))
SELECT dataset, event_id, epoch, k // quota * 20 + slot AS place FROM k JOIN slots USING (dataset) WHERE nth = k % quota AND k // quota * 20 + slot < total""")
def ord4_interleaved(spark, d):
    e = placed_events(spark, d)
    return S.interleaved(e, WEIGHTS, 2 * e.count()).select("dataset", "event_id", "epoch", "place")


@query("SELECT count(*) AS n, sum(place)::BIGINT AS total, true AS near FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS place FROM events)")
def ord3_buffered(spark, d):
    """A shuffle as by a buffer of 1000 rows: all rows are there, and none is 1000 places or more from its own."""
    places = dense_positions(table(spark, d, "events").select("event_id"), "event_id").withColumnRenamed("pos", "place")
    new = dense_positions(S.buffered(places, 1000, 42), ["at", "place"])
    return new.agg(F.count("*").alias("n"), F.sum("place").alias("total"), (F.max(F.abs(F.col("pos") - F.col("place"))) < 1000).alias("near"))


@query("SELECT s_suppkey, e AS epoch FROM supplier, range(3) r(e)")
def ord5_repeated(spark, d):
    return S.repeated(table(spark, d, "supplier").select("s_suppkey"), 3)


@query("SELECT pos // 64 AS batch, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) WHERE pos < (SELECT count(*) FROM events) // 64 * 64 GROUP BY 1")
def ord6_ord7_batches(spark, d):
    e = dense_positions(table(spark, d, "events").select("event_id"), "event_id")
    return S.batches(e, 64).groupBy("batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("SELECT rank, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % 8 AS rank FROM orders) GROUP BY 1")
def ord8_ord9_strided(spark, d):
    o = dense_positions(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    return S.strided(o, 8).groupBy("rank").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("total"))


@query("SELECT worker, count(*) AS n, min(s_suppkey) AS first FROM (SELECT s_suppkey, least((row_number() OVER (ORDER BY s_suppkey) - 1) // ((SELECT count(*) FROM supplier) // 7), 6) AS worker FROM supplier) GROUP BY 1")
def ord10_contiguous(spark, d):
    s = table(spark, d, "supplier")
    p = dense_positions(s.select("s_suppkey"), "s_suppkey")
    return p.withColumn("worker", S.contiguous(F.col("pos"), F.lit(s.count()), 7)).groupBy("worker").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))


@query("WITH {traj} SELECT episode, t FROM traj")
def ord11_by_locality(spark, d):
    return S.by_locality(traj(spark, d).select("episode", "t"), "episode", "t")


@query("SELECT n_name AS suite, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey) AS place FROM nation")
def ord12_longest_first(spark, d):
    s = table(spark, d, "nation").select(F.col("n_name").alias("suite"), F.col("n_regionkey").alias("max_steps"), F.col("n_nationkey").alias("start"))
    return S.longest_first(s).select("suite", long(F.row_number().over(Window.orderBy(F.desc("max_steps"), "start"))).alias("place"))


@query("SELECT category, row_number() OVER (ORDER BY CASE category WHEN 'Language Instructions' THEN 2 WHEN 'Sensor Noise' THEN 5 ELSE 7 END, category) AS place FROM (SELECT DISTINCT c_mktsegment AS category FROM customer UNION ALL SELECT 'Sensor Noise' UNION ALL SELECT 'Language Instructions')")
def ord13_category_order(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("category")).distinct()
    c = c.unionByName(spark.createDataFrame([("Sensor Noise",), ("Language Instructions",)], "category string"))
    return c.select("category", long(F.row_number().over(Window.orderBy(category_rank(F.col("category")), "category"))).alias("place"))


@query(f"SELECT event_id FROM events ORDER BY {KEY}, event_id LIMIT 100")
def ord14_sample_k(spark, d):
    return S.sample_k(table(spark, d, "events"), 100, "event_id", 42).select("event_id")


@query("SELECT vec_id, arg_min(c, {'e': round(list_sum(list_transform(embedding::DOUBLE[], lambda v: abs(v - c / 64.0))), 9), 'c': c})::BIGINT AS best FROM embeddings, range(-64, 65) r(c) GROUP BY vec_id")
def ord15_nearest_candidate(spark, d):
    candidates = F.sequence(F.lit(-64).cast("long"), F.lit(64).cast("long"))
    error = lambda c: F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + F.abs(x - c / 64.0)), 9)
    return vectors(spark, d).select("vec_id", S.nearest_candidate(candidates, error).alias("best"))


@query("SELECT name, levenshtein(name, 'NATION_11x')::BIGINT AS distance FROM (SELECT n_name AS name FROM nation) ORDER BY 2, 1 LIMIT 1")
def ord16_closest_name(spark, d):
    return S.closest_name(table(spark, d, "nation").select(F.col("n_name").alias("name")), "NATION_11x").withColumn("distance", long("distance"))
