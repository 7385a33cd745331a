"""Intervals and sets over the test tables."""

from pyspark.sql import functions as F

from kinelake.operators import intervals as I
from kinelake.plans.registry import exploded, long, query, table

DONE = """done AS (SELECT o_custkey % 20 AS suite, o_orderkey AS s, o_orderkey + 1 + o_custkey % 25 AS e FROM orders WHERE o_orderstatus = 'O'),
totals AS (SELECT o_custkey % 20 AS suite, max(o_orderkey) + 50 AS total FROM orders GROUP BY 1),
b AS (SELECT *, max(e) OVER (PARTITION BY suite ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM done),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY suite ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM b),
merged AS (SELECT suite, min(s) AS s, max(e) AS e FROM r GROUP BY suite, run),
g AS (SELECT suite, e AS s, lead(s) OVER (PARTITION BY suite ORDER BY s, e) AS e FROM (SELECT * FROM merged UNION ALL SELECT suite, 0, 0 FROM totals)),
gaps AS (SELECT suite, s, least(coalesce(e, total), total) AS e FROM g JOIN totals USING (suite) WHERE s < least(coalesce(e, total), total))"""


def done(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus = 'O'")
    return o.select((F.col("o_custkey") % 20).alias("suite"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1 + F.col("o_custkey") % 25).alias("end"))


def totals(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_custkey") % 20).alias("suite")).agg((F.max("o_orderkey") + 50).alias("total"))


@query("WITH " + DONE + ' SELECT suite, s AS start, e AS "end" FROM merged')
def int1_merge(spark, d):
    return I.merge(done(spark, d), "suite")


@query("WITH " + DONE + ' SELECT suite, s AS start, e AS "end" FROM gaps')
def int2_complement(spark, d):
    return I.complement(I.merge(done(spark, d), "suite"), totals(spark, d), "suite")


@query("WITH " + DONE + " SELECT suite, total, coalesce(c, 0) AS covered, total - coalesce(c, 0) AS missing FROM totals LEFT JOIN (SELECT suite, sum(e - s)::BIGINT AS c FROM merged GROUP BY 1) USING (suite)")
def int3_coverage(spark, d):
    return I.coverage(I.merge(done(spark, d), "suite"), totals(spark, d), "suite")


@query("WITH " + DONE + ' SELECT suite, x AS start, least(x + 7, e) AS "end" FROM (SELECT suite, e, unnest(range(s, e, 7)) AS x FROM gaps)')
def int4_split(spark, d):
    gaps = I.complement(I.merge(done(spark, d), "suite"), totals(spark, d), "suite")
    return I.split(gaps, 7)


NAMES = "CASE WHEN o_orderkey % 5 = 0 THEN 'overall.json' WHEN o_orderkey % 5 = 1 THEN o_orderkey || '_' || o_custkey || '.json.tmp' ELSE o_orderkey || '_' || o_custkey || '.json' END"


@query("SELECT o_orderkey AS start, o_custkey AS \"end\" FROM orders WHERE regexp_full_match(" + NAMES + ", '\\d+_\\d+\\.json')")
def int5_parse_names(spark, d):
    p = table(spark, d, "orders").select(I.parse_names(F.expr(NAMES)).alias("p")).filter("p IS NOT NULL")
    return p.select("p.start", "p.end")


@query("SELECT 'suite_' || (o_custkey % 4) AS suite, o_orderkey AS start, o_orderkey + 100 AS \"end\" FROM orders WHERE o_orderkey % 3 = 2")
def int6_parse_shard_list(spark, d):
    line = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN '# a comment' WHEN o_orderkey % 3 = 1 THEN '   ' ELSE concat('  suite_', o_custkey % 4, '   ', o_orderkey, ' ', o_orderkey + 100, '  # note') END")
    return I.parse_shard_list(table(spark, d, "orders").select(line.alias("value")))


@query("SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier UNION ALL SELECT p_partkey, 'part' FROM part")
def set1_union(spark, d):
    pick = lambda t, c: table(spark, d, t).select(F.col(c).alias("id"), F.lit(t).alias("kind"))
    return I.union_all(pick("customer", "c_custkey"), pick("supplier", "s_suppkey"), pick("part", "p_partkey"))


@query("SELECT key, arg_max(v, shard) AS v FROM (SELECT o_orderkey AS key, o_totalprice AS v, 0 AS shard FROM orders UNION ALL SELECT o_orderkey, -o_totalprice, 1 FROM orders WHERE o_orderkey % 3 = 0) GROUP BY key")
def set2_upsert(spark, d):
    from kinelake.operators.aggregates import last_wins

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("v"))
    shards = I.union_all(o.withColumn("shard", F.lit(0)), o.filter("key % 3 = 0").select("key", (-F.col("v")).alias("v"), F.lit(1).alias("shard")))
    return last_wins(shards, "key", "shard").select("key", "v")


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS n_extra FROM orders GROUP BY 1")
def set3_difference(spark, d):
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("s"))
    return sets.select("o_custkey", long(F.size(F.array_except("s", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))))).alias("n_extra"))


@query("SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0 INTERSECT SELECT l_suppkey FROM lineitem")
def set4_intersection(spark, d):
    key = lambda t, c, w="true": table(spark, d, t).filter(w).select(F.col(c).alias("key"))
    return I.done_in_every([key("orders", "o_custkey"), key("customer", "c_custkey", "c_acctbal > 0"), key("lineitem", "l_suppkey")], "key")


@query("SELECT id, (row_number() OVER (PARTITION BY id ORDER BY v) - 1) AS pos, v FROM (SELECT DISTINCT p_partkey AS id, CASE WHEN b < 0 THEN b + 40 ELSE b END AS v FROM part, LATERAL (SELECT unnest([p_size::BIGINT % 40, -1 - p_partkey % 7, p_partkey % 3]) AS b)) UNION ALL SELECT -1, pos, pos * 8 + 7 FROM range(5) r(pos)")
def set5_block_indices(spark, d):
    wanted = F.array(F.col("p_size").cast("long") % 40, -1 - F.col("p_partkey") % 7, F.col("p_partkey") % 3)
    own = exploded(table(spark, d, "part").select(F.col("p_partkey").alias("id"), I.block_indices(wanted, 40).alias("b")), "b", "id")
    every = spark.createDataFrame([(-1, i, b) for i, b in enumerate(I.every_kth_block(8, 40))], "id bigint, pos bigint, v bigint")
    return own.unionByName(every)
