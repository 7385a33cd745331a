"""Vector, text and image functions over the test tables."""

from importlib.util import find_spec

from pyspark.sql import functions as F

from kinelake.functions import texts as X
from kinelake.functions import vectors as V
from kinelake.plans.registry import exploded, long, query, r6, table, traj, vectors
from kinelake.sources import shared

ALL = "SELECT vec_id, i - 1 AS pos, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)"


def out(df, c, *keys):
    return exploded(df.withColumn("__a", c), "__a", *keys).withColumn("v", r6("v"))


def sql_of(expression: str) -> str:
    """SQL for an expression of x, pos over all dimensions."""
    return f"SELECT vec_id, pos, round({expression}, 6) AS v FROM ({ALL})"


#: Statistics of 65 dimensions, one more than the vectors have; ``SOME`` of them where the rest is to stay as it is.
MEAN, STD = [i % 7 / 100 for i in range(65)], [0.1 + i % 5 / 50 for i in range(65)]
Q01, Q99, SOME = [-0.3 - i % 3 / 100 for i in range(65)], [0.3 + i % 4 / 100 for i in range(65)], 50
at = lambda xs: str(xs) + "[pos + 1]"


@query(sql_of(f"(x - {at(MEAN)}) / ({at(STD)} + 1e-6)"))
def vec1_normalize_z(spark, d):
    return out(vectors(spark, d), V.normalize_z(F.col("x"), V.doubles(MEAN), V.doubles(STD)), "vec_id")


@query(sql_of(f"(x - {at(Q01)}) / ({at(Q99)} - {at(Q01)} + 1e-6) * 2 - 1"))
def vec2_vec5_normalize_q(spark, d):
    return out(vectors(spark, d), V.normalize_q(F.col("x"), V.doubles(Q01), V.doubles(Q99)), "vec_id")


@query(sql_of(f"CASE WHEN pos < {SOME} THEN x * ({at(STD)} + 1e-6) + {at(MEAN)} ELSE x * (1 + 1e-6) END"))
def vec3_unnormalize_z(spark, d):
    return out(vectors(spark, d), V.unnormalize_z(F.col("x"), V.doubles(MEAN[:SOME]), V.doubles(STD[:SOME])), "vec_id")


@query(sql_of(f"CASE WHEN pos < {SOME} THEN (x + 1) / 2 * ({at(Q99)} - {at(Q01)} + 1e-6) + {at(Q01)} ELSE x END"))
def vec4_unnormalize_q(spark, d):
    return out(vectors(spark, d), V.unnormalize_q(F.col("x"), V.doubles(Q01[:SOME]), V.doubles(Q99[:SOME])), "vec_id")


@query(sql_of(f"(x - {at(MEAN)}) / ({at(STD)} + 1e-6)").replace(" FROM (", ", true AS outward_fails FROM ("))
def vec6_strictness(spark, d):
    """Inward, statistics of a column that isn't there are ignored; outward they are an error."""
    from kinelake.plans.pipelines import normalize

    v = vectors(spark, d)
    stats = {"x": {"mean": MEAN, "std": STD}, "actions": {"mean": MEAN, "std": STD}}
    try:
        v.transform(normalize(stats, False, inverse=True))
        fails = False
    except ValueError:
        fails = True
    return exploded(v.transform(normalize(stats, False)), "x", "vec_id").select("vec_id", "pos", r6("v").alias("v"), F.lit(fails).alias("outward_fails"))


@query(sql_of(f"(x - {at(Q01)}) / ({at(Q99)} - {at(Q01)} + 1e-6) * 2 - 1").replace(" FROM (", ", true AS fails_without FROM ("))
def vec7_needs_quantiles(spark, d):
    """Normalising by quantiles needs both of them for every key."""
    from kinelake.plans.pipelines import normalize

    fails = 0
    for stats in ({"q01": Q01}, {"q99": Q99}, {"mean": MEAN, "std": STD}):
        try:
            normalize({"x": stats}, True)
        except ValueError:
            fails += 1
    v = vectors(spark, d).transform(normalize({"x": {"q01": Q01, "q99": Q99}}, True))
    return exploded(v, "x", "vec_id").select("vec_id", "pos", r6("v").alias("v"), F.lit(fails == 3).alias("fails_without"))


CHUNKS = "SELECT a.vec_id, c.c AS row, i - 1 AS pos, b.embedding[i]::DOUBLE AS a, a.embedding[i]::DOUBLE AS s FROM embeddings a, range(2) c(c), range(1, 65) r(i), embeddings b WHERE b.vec_id = a.vec_id + c.c"


def chunked(spark, d):
    v = vectors(spark, d)
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id", "left")
    return pairs.withColumn("actions", F.filter(F.array("x", "y"), lambda a: a.isNotNull()))


def rows_of(df, c):
    rows = df.select("vec_id", F.posexplode(c).alias("row", "a"))
    return rows.select("vec_id", long("row").alias("row"), F.posexplode("a").alias("pos", "v")).select("vec_id", "row", long("pos").alias("pos"), r6("v").alias("v"))


@query(f"SELECT vec_id, row, pos, round(a - CASE WHEN pos IN (0, 1) THEN s ELSE 0 END, 6) AS v FROM ({CHUNKS})")
def vec8_vec10_delta_actions(spark, d):
    return rows_of(chunked(spark, d), V.delta_actions(F.col("actions"), F.col("x"), V.make_bool_mask(2, -1)))


@query(f"SELECT vec_id, row, pos, round(a + CASE WHEN pos IN (0, 1) THEN s ELSE 0 END, 6) AS v FROM ({CHUNKS})")
def vec9_absolute_actions(spark, d):
    return rows_of(chunked(spark, d), V.absolute_actions(F.col("actions"), F.col("x"), V.make_bool_mask(2, -1)))


@query("SELECT vec_id, i AS pos, round(CASE WHEN i < 64 THEN embedding[i + 1]::DOUBLE ELSE 0 END, 6) AS v FROM embeddings, range(70) r(i)")
def vec11_pad(spark, d):
    return out(vectors(spark, d), V.pad(F.col("x"), 70), "vec_id")


@query("SELECT vec_id, i - 1 AS pos, round([1, -1, -1, 1, 1, 1, 1, 1, -1, -1, 1, 1, 1, 1][i] * embedding[i]::DOUBLE, 6) AS v FROM embeddings, range(1, 15) r(i)")
def vec12_flip_joints(spark, d):
    return out(vectors(spark, d, 14), V.flip_joints(F.col("x")), "vec_id")


@query("""WITH p AS (SELECT event_id, value / 500 * (0.058 - 0.01844) + 0.01844 AS p, value / 500 AS v FROM events)
SELECT event_id, round((asin(greatest(-1, least(1, (0.022 * 0.022 + p * p - 0.036 * 0.036) / (2 * 0.022 * p)))) - 0.5476) / (1.6296 - 0.5476), 6) AS angular,
round((v + 0.5476 + 0.6213) / (1.491 + 0.6213), 6) AS from_angular, round(v * (1.491 + 0.6213) - 0.6213 - 0.5476, 9) AS inverse FROM p""")
def vec13_vec14_gripper(spark, d):
    v = F.col("value") / 500
    return table(spark, d, "events").select("event_id", r6(V.gripper_to_angular(v)).alias("angular"), r6(V.gripper_from_angular(v)).alias("from_angular"), F.round(V.gripper_from_angular_inv(v), 9).alias("inverse"))


@query("""WITH q AS (SELECT vec_id, greatest(-1, least(1, embedding[4]::DOUBLE * 8)) AS w, embedding FROM embeddings)
SELECT vec_id, i - 1 AS pos, round(CASE WHEN 1 - w * w = 0 THEN 0 ELSE embedding[i]::DOUBLE * 8 * 2 * acos(w) / sqrt(1 - w * w) END, 6) AS v FROM q, range(1, 4) r(i)""")
def vec15_axis_angle(spark, d):
    return out(vectors(spark, d, 4), V.quat_to_axis_angle(F.transform("x", lambda v: v * 8.0)), "vec_id")


@query(sql_of("CASE WHEN pos = 63 THEN CASE WHEN x * 10 > 0.5 THEN 1 ELSE 0 END ELSE greatest(-1, least(1, x * 10)) END"))
def vec16_binarize(spark, d):
    return out(vectors(spark, d), V.binarize_gripper(F.transform("x", lambda v: v * 10.0)), "vec_id")


NORM = "greatest(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda v: v * v))), 1e-6)"


@query(f"SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE / {NORM} * 3, 6) AS v FROM embeddings, range(1, 65) r(i)")
def vec17_match_magnitude(spark, d):
    return out(vectors(spark, d), V.match_magnitude(F.col("x"), "constant", 3.0), "vec_id")


@query("""WITH c AS (SELECT a.vec_id, a.label::BIGINT AS label, list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) AS c
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT label, round(sum(CASE WHEN vec_id % 3 > 0 THEN 1 - c END) / count(CASE WHEN vec_id % 3 > 0 THEN 1 END), 6) AS loss,
round(sum(CASE WHEN vec_id % 3 > 0 THEN 1 - c ELSE 1 END) / count(CASE WHEN vec_id % 3 > 0 THEN 1 END), 6) AS loss_counting_masked FROM c GROUP BY 1""")
def vec18_cosine_loss(spark, d):
    v = vectors(spark, d)
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    c, on = V.dot(F.col("x"), F.col("y")), F.col("vec_id") % 3 > 0
    n = F.count(F.when(on, 1))
    return p.groupBy("label").agg(r6(F.sum(F.when(on, 1 - c)) / n).alias("loss"), r6(F.sum(F.when(on, 1 - c).otherwise(1.0)) / n).alias("loss_counting_masked"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: v / 0.07) AS l FROM embeddings)
SELECT vec_id, round(ln(list_sum(list_transform(l, lambda v: exp(v - list_max(l))))) + list_max(l) - ln(list_sum(list_transform(l[1:4], lambda v: exp(v - list_max(l[1:4]))))) - list_max(l[1:4]), 6) AS loss FROM e""")
def vec19_info_nce(spark, d):
    v = vectors(spark, d).withColumn("x", F.transform("x", lambda a: a / 0.07))
    return v.select("vec_id", r6(V.info_nce(F.slice("x", 1, 4), F.col("x"))).alias("loss"))


@query("""SELECT t, i AS pos, round(CASE WHEN i < 8 THEN sin(t * exp(-ln(10000) / 8 * i)) ELSE cos(t * exp(-ln(10000) / 8 * (i - 8))) END, 6) AS v,
round(CASE WHEN i < 8 THEN sin(t * pow(100, -i / 8.0)) ELSE cos(t * pow(100, -(i - 8) / 8.0)) END, 6) AS w FROM range(-8, 9) a(t), range(16) b(i)""")
def vec20_embeddings(spark, d):
    t = spark.range(-8, 9).withColumnRenamed("id", "t")
    a = exploded(t.withColumn("a", F.arrays_zip(V.temporal_embedding(F.col("t"), 16).alias("v"), V.position_embedding(F.col("t"), 16).alias("w"))), "a", "t")
    return a.select("t", "pos", r6("v.v").alias("v"), r6("v.w").alias("w"))


@query("""SELECT r AS row, c AS "column", round((-1 + 2 * c / 3.0) * (1 / sqrt(2)) * 3 / 4, 6) AS u, round((-1 + 2 * r / 2.0) * (1 / sqrt(2)) * 2 / 3, 6) AS v FROM range(3) a(r), range(4) b(c)""")
def vec20_grid(spark, d):
    return spark.createDataFrame([(r, c, round(u, 6), round(v, 6)) for r, c, u, v in V.grid_coordinates(4, 3)], "row bigint, column bigint, u double, v double")


@query("SELECT vec_id, b AS bin, round(avg(embedding[i]::DOUBLE), 6) AS v FROM embeddings, (SELECT i, (i - 1) // 16 AS b FROM range(1, 65) r(i)) GROUP BY 1, 2")
def vec21_pool(spark, d):
    p = exploded(vectors(spark, d), "x", "vec_id")
    return p.groupBy("vec_id", long(F.floor(F.col("pos") * 4 / 64)).alias("bin")).agg(r6(F.avg("v")).alias("v"))


@query("SELECT n, n // (max(s) * max(s)) AS cameras, max(s) AS side FROM range(1, 300) a(n), range(1, 20) b(s) WHERE n % (s * s) = 0 GROUP BY n")
def vec22_square_grid(spark, d):
    return spark.createDataFrame([(n, *V.square_grid(n)) for n in range(1, 300)], "n bigint, cameras bigint, side bigint")


BINS = [7, 5, 5, 5, 5]
PLACES = [1, 7, 35, 175, 875]


@query(f"""WITH t AS (SELECT vec_id, list_sum(list_transform(range(1, 6), lambda i: round_even((greatest(-1, least(1, embedding[i]::DOUBLE * 5)) + 1) * ({BINS}[i] - 1) / 2, 0)::BIGINT * {PLACES}[i]))::BIGINT AS token FROM embeddings)
SELECT vec_id, token, i - 1 AS pos, round((token // {PLACES}[i]) % {BINS}[i] / ({BINS}[i] - 1) * 2 - 1, 6) AS v FROM t, range(1, 6) r(i)""")
def vec23_fsq(spark, d):
    z = F.transform("x", lambda v: F.greatest(F.least(v * 5.0, F.lit(1.0)), F.lit(-1.0)))
    t = vectors(spark, d, 5).withColumn("token", V.fsq_encode(z, V.FSQ_BINS[2**12]))
    return out(t, V.fsq_decode(F.col("token"), V.FSQ_BINS[2**12]), "vec_id", "token")


@query("""SELECT s * 50 AS step, round(1e6 * CASE WHEN s * 50 < 1000 THEN 2.5e-5 / 1001 + (2.5e-5 - 2.5e-5 / 1001) * s * 50 / 1000 ELSE 2.5e-6 + 2.25e-5 * 0.5 * (1 + cos(pi() * least(1, (s * 50 - 1000) / 29000))) END, 6) AS cosine,
round(1e6 * CASE WHEN s * 50 < 1000 THEN 5e-5 / 1001 + (5e-5 - 5e-5 / 1001) * s * 50 / 1000 ELSE 5e-5 / sqrt((10000 + s * 50 - 1000) / 10000) END, 6) AS rsqrt FROM range(800) r(s)""")
def vec24_schedules(spark, d):
    s = spark.range(800).select((F.col("id") * 50).alias("step"))
    return s.select("step", r6(1e6 * V.warmup_cosine(F.col("step"), 1000, 2.5e-5, 30000, 2.5e-6)).alias("cosine"), r6(1e6 * V.warmup_rsqrt(F.col("step"), 1000, 5e-5, 10000.0)).alias("rsqrt"))


@query("""WITH m AS (SELECT event_type, event_id, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS v FROM events WINDOW w AS (PARTITION BY event_type))
SELECT event_id, c AS channel, floor(greatest(0, least(1, 1.5::DOUBLE - abs(4.0::DOUBLE * v - (3 - c)))) * 255)::BIGINT AS colour, floor(greatest(0, least(255, 100 * 0.5::DOUBLE + floor(greatest(0, least(1, 1.5::DOUBLE - abs(4.0::DOUBLE * v - (3 - c)))) * 255) * 0.5)))::BIGINT AS blended FROM m, range(3) r(c)""")
def vec25_heat_map(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type")
    span = F.max("value").over(w) - F.min("value").over(w)
    e = table(spark, d, "events").withColumn("v", F.when(span > 0, (F.col("value") - F.min("value").over(w)) / span).otherwise(0.0))
    c = exploded(e.withColumn("c", V.jet(F.col("v"))), "c", "event_id")
    return c.select("event_id", F.col("pos").alias("channel"), F.col("v").alias("colour"), V.blend(F.lit(100.0), F.col("v"), 0.5).alias("blended"))


@query("""SELECT event_id, round((value / 500 - 0.01244) / (0.02417 - 0.01244) * (0.058 - 0.01844) + 0.01844, 6) AS position, round((value / 500 + 0.6842) / (0.3083 + 0.6842) * (1.491 + 0.6213) - 0.6213, 6) AS joint,
round((value / 500 - 0.01844) / (0.058 - 0.01844) * (1.491 + 0.6213) - 0.6213, 6) AS to_joint, round((value / 500 + 0.6213) / (1.491 + 0.6213) * (0.058 - 0.01844) + 0.01844, 6) AS to_position, round(value / 500 / (0.058 - 0.01844), 6) AS velocity FROM events""")
def vec27_gripper_units(spark, d):
    v = F.col("value") / 500
    return table(spark, d, "events").select("event_id", r6(V.master_to_puppet_position(v)).alias("position"), r6(V.master_to_puppet_joint(v)).alias("joint"), r6(V.puppet_position_to_joint(v)).alias("to_joint"), r6(V.puppet_joint_to_position(v)).alias("to_position"), r6(V.puppet_velocity(v)).alias("velocity"))


@query("SELECT s_suppkey, i AS pos, round(s_acctbal + (s_suppkey - s_acctbal) * i / 9, 6) AS v FROM supplier, range(10) r(i)")
def vec28_interpolate(spark, d):
    return out(table(spark, d, "supplier"), V.interpolate(F.col("s_acctbal"), F.col("s_suppkey").cast("double"), 10), "s_suppkey")


@query(sql_of("CASE WHEN pos = 1 THEN 5 WHEN pos = 3 THEN 4 ELSE x END"))
def vec29_put_along(spark, d):
    return out(vectors(spark, d), V.put_along(F.col("x"), F.array(F.lit(1), F.lit(3), F.lit(1)), V.doubles([2, 4, 3])), "vec_id")


WS = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("SELECT doc_id, md5(translate(" + WS.format("'  ' || text || chr(10)") + ", '_' || chr(10), '  ')) AS a, md5(translate(" + WS.format("lower('  ' || text || chr(10))") + ", '_', ' ')) AS b FROM documents")
def str1_str2_clean_prompt(spark, d):
    t = F.concat(F.lit("  "), F.col("text"), F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", F.md5(X.clean_prompt(t)).alias("a"), F.md5(X.clean_prompt_lower(t)).alias("b"))


DIGIT = "CASE WHEN isnan({0}) THEN 255 ELSE greatest(-1, least(255, floor(({0} + 1) * 128))) END"


@query("SELECT event_id, (" + DIGIT.format("v") + ")::BIGINT AS bin FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'NaN'::DOUBLE ELSE value / 100 - 2 END AS v FROM events)")
def str3_digitize(spark, d):
    v = F.when(F.col("event_id") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 100 - 2)
    return table(spark, d, "events").select("event_id", X.digitize(v).alias("bin"))


@query("SELECT vec_id, 'Task: pick ' || label || ', State: ' || array_to_string(list_transform(embedding::DOUBLE[], lambda v: floor((v + 1) * 128)::BIGINT), ' ') || ';' || chr(10) || 'Action: ' AS prompt FROM embeddings")
def str4_prompts(spark, d):
    v = vectors(spark, d)
    return v.select("vec_id", X.state_prompt(F.concat(F.lit("pick "), F.col("label").cast("string")), F.col("x"), True).alias("prompt"))


@query("WITH {traj} SELECT episode, p AS pos, coalesce(k, 0) AS v FROM (SELECT DISTINCT episode FROM traj) e, range(64) r(p) LEFT JOIN traj t ON false".replace(" LEFT JOIN traj t ON false", "").replace("SELECT episode, p AS pos, coalesce(k, 0) AS v FROM (SELECT DISTINCT episode FROM traj) e, range(64) r(p)", "SELECT e.episode, e.p AS pos, coalesce(t.k, 0) AS v FROM (SELECT episode, p FROM (SELECT DISTINCT episode FROM traj), range(64) r(p)) e LEFT JOIN traj t ON t.episode = e.episode AND t.t = e.p"))
def str5_fit_tokens(spark, d):
    s = traj(spark, d).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("t", "k"))).alias("s"))
    return exploded(s.withColumn("a", X.fit_tokens(F.col("s.k"), 64)), "a", "episode")


@query("WITH {traj} SELECT episode, t AS pos, CASE WHEN t < 10 THEN 0 ELSE 1 END::BIGINT AS ar, CASE WHEN t < 10 THEN 0 ELSE 1 END::BIGINT AS loss FROM traj")
def str6_masks(spark, d):
    s = traj(spark, d).groupBy("episode").agg(F.collect_list(F.struct("k")).alias("s"))
    ar, loss = X.token_masks(F.slice("s", 1, 10), F.slice("s", 11, F.greatest(F.size("s") - 10, F.lit(0))))
    a = exploded(s.withColumn("a", F.arrays_zip(ar.alias("ar"), loss.alias("loss"))), "a", "episode")
    return a.select("episode", "pos", "v.ar", "v.loss")


@query("SELECT p_partkey, i - 1 AS pos, ('0x' || substr(hex(encode(p_name || ' é')), 2 * i - 1, 2))::BIGINT AS v FROM part, LATERAL (SELECT unnest(range(1, strlen(p_name || ' é') + 1)) AS i)")
def str7_tokens(spark, d):
    from kinelake.plans.pipelines import TOKENIZERS

    t = TOKENIZERS["bytes"](F.concat("p_name", F.lit(" é")))
    return exploded(table(spark, d, "part").withColumn("a", t), "a", "p_partkey")


if find_spec("tokenizers") and find_spec("public_tokenizers"):

    @query("SELECT doc_id, md5(coalesce(text, '')) AS digest, true AS same_count FROM documents")
    def str7_library_tokens(spark, d):
        """A real vocabulary, both ways: texts come back, and as many tokens as were counted."""
        import public_tokenizers

        from kinelake.plans.pipelines import library_tokenizer

        encode, decode = library_tokenizer(spark, public_tokenizers.path("byte_bpe_50k.json"))
        shared.small_batches(spark)
        # A file may hold all texts in few row groups, so they are dealt out; each step is staged, else Spark runs it once for each use.
        dealt = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("doc_id")
        t = shared.staged(dealt.select("doc_id", encode("text").alias("tokens")), "tokens")
        back = shared.staged(t.select("doc_id", F.size("tokens").alias("n"), decode("tokens").alias("text")), "texts")
        return back.select("doc_id", F.md5("text").alias("digest"), (F.col("n") == F.size(encode("text"))).alias("same_count"))


@query("SELECT event_id, 257152 - 1 - 128 - event_id AS token, event_id AS back FROM events")
def str8_action_tokens(spark, d):
    t = X.action_token(F.col("event_id"), 257152)
    return table(spark, d, "events").select("event_id", long(t).alias("token"), long(X.action_token(t, 257152)).alias("back"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS action FROM orders")
def str9_action_text(spark, d):
    s = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("Task: x;\nAction:  "), F.col("o_orderpriority"), F.lit(" | rest|")))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(X.action_text(s), F.lit("")).alias("action"))


@query("WITH {traj}, n AS (SELECT episode, count(*) AS n FROM traj GROUP BY 1) SELECT episode, t // 4 AS row, t % 4 AS pos, round(CASE WHEN n < 48 THEN 0 ELSE k / 256.0 * 2 - 1 END, 6) AS v FROM traj JOIN n USING (episode) WHERE t < 48")
def str10_bin_values(spark, d):
    s = traj(spark, d).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("t", "k"))).alias("s"))
    rows = s.select("episode", F.posexplode(X.bin_values(F.col("s.k"), 256, 12, 4)).alias("row", "a"))
    return rows.select("episode", long("row").alias("row"), F.posexplode("a").alias("pos", "v")).select("episode", "row", long("pos").alias("pos"), r6("v").alias("v"))


@query("SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents")
def str11_decode(spark, d):
    s = F.decode(F.encode("text", "UTF-8"), "UTF-8")
    return table(spark, d, "documents").select("doc_id", long(F.char_length(s)).alias("n"), F.md5(s).alias("digest"))


@query("SELECT doc_id, substr(regexp_replace(" + WS.format("text") + ", '[^\\p{L}\\p{N}_.-]', '_', 'g'), 1, 60) AS name FROM documents")
def str12_safe_name(spark, d):
    return table(spark, d, "documents").select("doc_id", X.safe_name(F.col("text")).alias("name"))


@query("""WITH s AS (SELECT doc_id, replace(text, ' ', '_') AS s FROM documents), n AS (SELECT doc_id, s, 'rollout_' || s || '_success.mp4' AS name FROM s)
SELECT doc_id, CASE WHEN strlen(name) > 250 THEN 'rollout_' || substr(s, 1, 217) || '_' || substr(md5(s), 1, 12) || '_success.mp4' ELSE name END AS name FROM n""")
def str13_video_name(spark, d):
    return table(spark, d, "documents").select("doc_id", X.video_name(F.col("text"), F.lit("success")).alias("name"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '/a/b/backup/wandit_cache__x' || o_custkey WHEN 1 THEN '/a/b/backup/wan21dit_cache__x' || o_custkey WHEN 2 THEN '/a/b/cosmosdit_post_cache__x' || o_custkey ELSE '/a/b/other' || o_custkey || '__merged' END AS prefix FROM orders""")
def str14_merged_prefix(spark, d):
    f = F.concat(F.lit("/a/b/"), F.element_at(F.array(*map(F.lit, ("_wandit_tmp__x", "_wan21dit_tmp__x", "_cosmosdit_post_tmp__x", "other"))), (F.col("o_orderkey") % 4 + 1).cast("int")), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", X.merged_prefix(f).alias("prefix"))


@query("SELECT n_nationkey::BIGINT AS n, CASE n_nationkey % 4 WHEN 0 THEN 'post' WHEN 1 THEN 'distilled' WHEN 2 THEN 'v1_' || n_nationkey ELSE 'rev' END AS tag FROM nation")
def str15_revision_tag(spark, d):
    r = F.expr("CASE n_nationkey % 4 WHEN 0 THEN 'diffusers/base/post-trained' WHEN 1 THEN 'diffusers/base/distilled/' WHEN 2 THEN concat('a/v1.', n_nationkey) ELSE '-trained' END")
    return table(spark, d, "nation").select(long("n_nationkey").alias("n"), X.revision_tag(r).alias("tag"))


@query("SELECT s_suppkey, 'f' || (s_suppkey % 3) || '_' || s_suppkey AS tag FROM supplier")
def str16_tags(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", X.offsets_tag(F.array(F.col("s_suppkey") % 3, "s_suppkey")).alias("tag"))


@query("SELECT o_orderkey, o_custkey::VARCHAR AS episode FROM orders")
def str17_str18_episode_of_metadata(spark, d):
    p = F.concat(F.lit("/data/x.y/metadata_lab_"), F.col("o_custkey").cast("string"), F.lit(".json"))
    return table(spark, d, "orders").select("o_orderkey", X.episode_of_metadata(p).alias("episode"))


@query("""WITH s AS (SELECT o_orderkey, 10 + o_orderkey % 500 AS h, 10 + o_custkey % 700 AS w FROM orders), r AS (SELECT *, greatest(w / 224.0::DOUBLE, h / 224.0::DOUBLE) AS r FROM s),
z AS (SELECT o_orderkey, floor(h / r)::BIGINT AS height, floor(w / r)::BIGINT AS width FROM r)
SELECT *, (224 - height) // 2 AS top, (224 - width) // 2 AS "left", 224 - height - (224 - height) // 2 AS bottom, 224 - width - (224 - width) // 2 AS "right" FROM z""")
def img1_resize_geometry(spark, d):
    g = X.resize_with_pad(10 + F.col("o_orderkey") % 500, 10 + F.col("o_custkey") % 700, 224, 224)
    return table(spark, d, "orders").select("o_orderkey", *(long(c).alias(n) for n, c in g.items()))


@query("SELECT vec_id, pos, b::BIGINT AS byte, round(b / 255.0 * 2 - 1, 6) AS unit FROM (SELECT vec_id, pos, CAST(trunc((x + 1) / 2 * 255) AS BIGINT) AS b FROM (" + ALL + "))")
def img2_img3_bytes(spark, d):
    p = exploded(vectors(spark, d), "x", "vec_id").withColumn("byte", X.float_to_byte((F.col("v") + 1) / 2))
    return p.select("vec_id", "pos", "byte", r6(X.byte_to_unit(F.col("byte"))).alias("unit"))
