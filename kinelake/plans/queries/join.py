"""Look-ups over the test tables."""

from pyspark.sql import functions as F

from kinelake.operators import joins as J
from kinelake.plans.registry import exploded, long, query, table, traj


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, p_name AS prompt, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3")
def join1_prompts(spark, d):
    tasks = table(spark, d, "part").select(F.col("p_partkey").alias("task_index"), F.col("p_name").alias("prompt"))
    f = table(spark, d, "lineitem").select("l_orderkey", long("l_linenumber").alias("l_linenumber"), F.col("l_partkey").alias("task_index"))
    return J.prompts(f, tasks).groupBy("l_orderkey", "l_linenumber", "prompt").agg(F.count("*").alias("n"))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' WHEN quality = 0 THEN 'bad' END, 'Do something') AS task FROM documents LEFT JOIN labels USING (doc_id)")
def join2_default(spark, d):
    names = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("task"))
    return J.with_default(table(spark, d, "documents").select("doc_id"), names, "doc_id", "task", "Do something")


@query("SELECT doc_id AS index, coalesce(toxic, -1)::BIGINT AS feature, coalesce(quality, -1)::BIGINT AS feature_aux FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels WHERE doc_id % 2 = 0) a USING (doc_id) LEFT JOIN (SELECT doc_id, quality FROM labels WHERE doc_id % 3 = 0) b USING (doc_id)")
def join3_join4_caches(spark, d):
    labels = table(spark, d, "labels").withColumnRenamed("doc_id", "index")
    f = table(spark, d, "documents").select(F.col("doc_id").alias("index"))
    main = labels.filter("index % 2 = 0").select("index", long("toxic").alias("feature"))
    aux = labels.filter("index % 3 = 0").select("index", long("quality").alias("feature_aux"))
    return J.cached(J.cached(f, main), aux).fillna(-1)


@query("WITH {traj} SELECT episode, t FROM traj WHERE (episode % 2 = 0 AND t >= 5 AND t < 15) OR (episode % 2 = 1 AND ((t >= 0 AND t < 3) OR (t >= 30 AND t < 40)))")
def join5_join13_ranges_of_datasets(spark, d):
    from kinelake.operators.filters import in_ranges

    ep = traj(spark, d).select("episode").distinct()
    even = ep.filter("episode % 2 = 0").select("episode", F.lit(5).alias("start"), F.lit(15).alias("end"))
    odd = ep.filter("episode % 2 = 1").select("episode", F.explode(F.expr("array(struct(0 AS start, 3 AS end), struct(30 AS start, 40 AS end))")).alias("r")).select("episode", "r.start", "r.end")
    return in_ranges(traj(spark, d), even.unionByName(odd)).select("episode", "t")


@query("SELECT p_partkey AS task_index, p_name AS task FROM part WHERE p_name IN (SELECT p_name FROM part JOIN lineitem ON p_partkey = l_partkey)")
def join7_used_tasks(spark, d):
    tasks = table(spark, d, "part").select(F.col("p_partkey").alias("task_index"), F.col("p_name").alias("task"))
    named = table(spark, d, "lineitem").join(tasks, F.col("l_partkey") == F.col("task_index"))
    episodes = named.groupBy("l_orderkey").agg(F.collect_set("task").alias("tasks"))
    return J.used_tasks(tasks, episodes)


@query("SELECT p_partkey AS task_id, coalesce(n_name, 'unknown') AS category, coalesce('name_' || n_nationkey, 'task_' || p_partkey) AS name FROM part LEFT JOIN nation ON p_partkey = n_nationkey - 1")
def join8_categories(spark, d):
    tasks = table(spark, d, "part").select(F.col("p_partkey").alias("task_id"))
    names = table(spark, d, "nation").select(long("n_nationkey").alias("id"), F.col("n_name").alias("category"), F.concat(F.lit("name_"), F.col("n_nationkey").cast("string")).alias("name"))
    return J.categories(tasks, names)


@query("""WITH l AS (SELECT 'layer/' || p_partkey AS key, p_retailprice AS v FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT 'layer/' || p_partkey AS key, p_size AS v FROM part WHERE p_partkey % 3 = 0)
SELECT key, CAST(trunc(l.v) AS INTEGER) AS value FROM l JOIN r USING (key) UNION ALL SELECT key, v FROM r WHERE key NOT IN (SELECT key FROM l) AND regexp_full_match(key, '.*[135]')""")
def join9_merge_parameters(spark, d):
    key = F.concat(F.lit("layer/"), F.col("p_partkey").cast("string")).alias("key")
    p = table(spark, d, "part")
    return J.merge_parameters(p.filter("p_partkey % 2 = 0").select(key, F.col("p_retailprice").alias("value")), p.filter("p_partkey % 3 = 0").select(key, F.col("p_size").alias("value")), ".*[135]")


@query("WITH {traj}, x AS (SELECT episode, g::DOUBLE AS target FROM (SELECT DISTINCT episode FROM traj), (VALUES (10), (50), (250)) v(g)) SELECT episode, target, arg_min(value, {'d': abs(value - target), 't': t}) AS nearest FROM x JOIN traj USING (episode) GROUP BY 1, 2")
def join10_nearest(spark, d):
    targets = traj(spark, d).select("episode").distinct().select("episode", F.explode(F.array(*map(F.lit, (10.0, 50.0, 250.0)))).alias("target"))
    return J.nearest(targets, traj(spark, d).select("episode", "value", F.col("t").alias("position")), "episode")


@query("SELECT p_partkey, p_name, length(p_name) AS n FROM part")
def join11_once_each(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return J.once_each(p, "p_name", lambda t: t.withColumn("n", long(F.char_length("p_name")))).select("p_partkey", "p_name", "n")


@query("""WITH {traj}, e AS (SELECT episode, t, event_id, value, epoch_us(ts) AS us FROM traj),
lim AS (SELECT episode, min(us) AS lo, max(us) AS hi, arg_min(value, {'u': us, 'i': event_id}) AS first, arg_min(value, {'u': -us, 'i': event_id}) AS last FROM e GROUP BY episode),
x AS (SELECT e.*, lim.* EXCLUDE (episode), pos, us + off AS target FROM e JOIN lim USING (episode), (VALUES (0, -172800000000), (1, 0), (2, 90000000000)) o(pos, off)),
near AS (SELECT x.event_id, x.pos, arg_min(b.value, {'d': abs(b.us - target), 'u': b.us, 'i': b.event_id}) AS v FROM x JOIN e b ON b.episode = x.episode AND abs(b.us - target) <= 43200000000 GROUP BY 1, 2)
SELECT episode, t, pos::BIGINT AS pos, CASE WHEN target < lo - 43200000000 THEN first WHEN target > hi + 43200000000 THEN last ELSE v END AS value, target < lo - 43200000000 OR target > hi + 43200000000 AS pad
FROM x LEFT JOIN near USING (event_id, pos)""")
def join12_at_times(spark, d):
    """Two days before, now, and 25 hours later, with half a day of tolerance: stamps are irregular and have gaps."""
    f = J.at_times(traj(spark, d), [-172800, 0, 90000], "value", tolerance=43200, tie="event_id")
    return exploded(f, "values", "episode", "t").select("episode", "t", "pos", "v.value", "v.pad")


@query("WITH {traj} SELECT episode, t, lead(value, 3) OVER (PARTITION BY episode ORDER BY t) AS ahead FROM traj")
def join12_time_offset(spark, d):
    return J.time_offset(traj(spark, d).select("episode", "t", "value"), 3, "value").select("episode", "t", "ahead")
