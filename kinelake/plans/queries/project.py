"""Nested records over the test tables."""

from pyspark.sql import functions as F

from kinelake.functions import texts, vectors as V
from kinelake.operators import project as P
from kinelake.plans import pipelines
from kinelake.plans.registry import exploded, long, query, r6, table, traj, vectors
from kinelake.sources import shared


def nested(spark, d):
    """Orders as nested records."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.struct(F.struct("o_orderstatus", "o_orderpriority").alias("state"), "o_totalprice").alias("obs"), F.struct(F.col("o_custkey").alias("id")).alias("cust"))


@query("SELECT o_orderkey AS key, o_orderstatus AS status, o_custkey AS id FROM orders")
def prj1_repack(spark, d):
    out = P.repack(nested(spark, d), {"key": "o_orderkey", "in": {"status": "obs/state/o_orderstatus", "who": {"id": "cust/id"}}})
    return out.select("key", "in.status", "in.who.id")


@query("SELECT o_orderkey, o_orderstatus AS \"obs/state/o_orderstatus\", o_orderpriority AS \"obs/state/o_orderpriority\", o_totalprice AS \"obs/o_totalprice\", o_custkey AS \"cust/id\" FROM orders")
def prj2_flatten(spark, d):
    return P.flatten(P.unflatten(P.flatten(nested(spark, d))))


@query("SELECT o_orderkey, o_orderstatus AS status, o_totalprice AS total FROM orders")
def prj3_rename(spark, d):
    out = P.rename(nested(spark, d), {"cust/.*": None, r"obs/state/o_order(.+)": r"meta/\1", r"obs/o_(.+)price": r"meta/\1", "meta/priority": None})
    return out.select("o_orderkey", "meta.status", "meta.total")


@query("SELECT o_orderkey, o_totalprice * 2 AS price, o_custkey + 1 AS id FROM orders")
def prj4_apply_to(spark, d):
    out = P.apply_to(nested(spark, d).select("o_orderkey", "obs", "cust"), {"obs/o_totalprice": lambda c: c * 2, "cust/id": lambda c: c + 1}, lambda c, f: f(c), strict=True)
    return out.select("o_orderkey", F.col("obs.o_totalprice").alias("price"), "cust.id")


@query("SELECT s_suppkey, 'do it' AS prompt FROM supplier UNION ALL SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name END, 'null') FROM part")
def prj5_default_prompt(spark, d):
    absent = P.default_prompt(table(spark, d, "supplier").select("s_suppkey"), "do it")
    there = P.default_prompt(table(spark, d, "part").select(F.col("p_partkey").alias("s_suppkey"), F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_name END").alias("prompt")), "do it")
    return absent.unionByName(there.fillna("null"))


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def prj6_remove_strings(spark, d):
    return P.remove_strings(table(spark, d, "customer"))


@query("SELECT s_suppkey * 2 + 1 AS x, (s_suppkey + 1) * 2 AS y FROM supplier")
def prj7_prj8_groups(spark, d):
    add = lambda c: lambda df: df.withColumn(c, F.col(c) + 1)
    twice = lambda c: lambda df: df.withColumn(c, F.col(c) * 2)
    g = P.Group().push(inputs=[twice("x")], outputs=[twice("y")]).push(inputs=[add("x")], outputs=[add("y")])
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("x"), F.col("s_suppkey").alias("y"))
    return s.transform(P.compose(*g.inputs)).transform(P.compose(*g.outputs))


@query("SELECT vec_id, i - 1 AS pos, round(CASE WHEN i = 65 THEN label::DOUBLE ELSE embedding[i]::DOUBLE END, 6) AS v FROM embeddings, range(1, 66) r(i)")
def prj9_joined(spark, d):
    v = vectors(spark, d)
    return exploded(v.withColumn("a", P.joined(F.col("x"), F.array(F.col("label").cast("double")))), "a", "vec_id").withColumn("v", r6("v"))


@query("SELECT a.vec_id, c AS row, i - 1 AS pos, round((c + 1) * a.embedding[i]::DOUBLE, 6) AS v FROM embeddings a, range(2) x(c), range(1, 8) r(i)")
def prj10_first_dims(spark, d):
    v = vectors(spark, d).withColumn("actions", F.array("x", F.transform("x", lambda a: a * 2)))
    rows = v.select("vec_id", F.posexplode(V.first_dims(F.col("actions"), 7)).alias("row", "a"))
    return rows.select("vec_id", long("row").alias("row"), F.posexplode("a").alias("pos", "v")).select("vec_id", "row", long("pos").alias("pos"), r6("v").alias("v"))


@query("""SELECT * FROM (VALUES ('libero_flow', 'base_0_rgb', true), ('libero_flow', 'left_wrist_0_rgb', true), ('libero_flow', 'right_wrist_0_rgb', false),
('libero_fast', 'base_0_rgb', true), ('libero_fast', 'left_wrist_0_rgb', true), ('libero_fast', 'right_wrist_0_rgb', true),
('droid_flow', 'base_0_rgb', true), ('droid_flow', 'left_wrist_0_rgb', true), ('droid_flow', 'right_wrist_0_rgb', false),
('droid_fast', 'base_0_rgb', true), ('droid_fast', 'base_1_rgb', true), ('droid_fast', 'wrist_0_rgb', true)) v(config, slot, mask)""")
def prj11_prj12_masks(spark, d):
    one = spark.range(1)
    parts = [one.select(F.lit(name).alias("config"), F.explode(m).alias("slot", "mask")) for name, m in (("libero_flow", P.libero_masks("flow")), ("libero_fast", P.libero_masks("fast")), ("droid_flow", P.droid_masks("flow")), ("droid_fast", P.droid_masks("fast")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT s_suppkey, c AS camera, CASE c WHEN 'cam_high' THEN true WHEN 'cam_low' THEN s_suppkey % 2 = 0 WHEN 'cam_left_wrist' THEN s_suppkey % 3 = 0 ELSE false END AS mask FROM supplier, (VALUES ('cam_high'), ('cam_low'), ('cam_left_wrist'), ('cam_right_wrist')) v(c)")
def prj13_aloha_masks(spark, d):
    names = F.expr("filter(array('cam_high', if(s_suppkey % 2 = 0, 'cam_low', NULL), if(s_suppkey % 3 = 0, 'cam_left_wrist', NULL)), x -> x IS NOT NULL)")
    images = F.map_from_arrays(names, F.transform(names, lambda n: F.lit(1)))
    return table(spark, d, "supplier").select("s_suppkey", F.explode(P.aloha_masks(images)).alias("camera", "mask"))


PICK = "('0x' || substr(md5(episode || ':' || {}), 1, 8))::BIGINT % {}"


@query("WITH {traj} SELECT episode, t, " + PICK.format(1, 2) + " AS camera, " + PICK.format(2, 3) + " AS instruction FROM traj")
def prj14_pick_per_episode(spark, d):
    return traj(spark, d).select("episode", "t", P.pick_per_episode(F.col("episode"), 1, 2).alias("camera"), P.pick_per_episode(F.col("episode"), 2, 3).alias("instruction"))


@query("WITH {traj} SELECT 'user' || episode || '--' || event_type || '--' || t AS id FROM traj")
def prj15_step_id(spark, d):
    return traj(spark, d).select(texts.step_id(F.concat(F.lit("user"), F.col("episode").cast("string")), F.col("event_type"), F.col("t")).alias("id"))


@query("SELECT vec_id, (i - 1) // 3 AS pos, round(embedding[i]::DOUBLE, 6) AS v FROM embeddings, range(1, 65, 3) r(i)")
def prj16_every(spark, d):
    return exploded(vectors(spark, d).withColumn("a", V.every(F.col("x"), 3)), "a", "vec_id").withColumn("v", r6("v"))


@query("SELECT vec_id, pos, round((b::DOUBLE) / 255 * 2 - 1, 6) AS v FROM (SELECT vec_id, i - 1 AS pos, floor((embedding[i]::DOUBLE + 1) * 100) AS b FROM embeddings, range(1, 65) r(i))")
def prj18_observation(spark, d):
    from kinelake.sources.readers import observation

    img = F.create_map(F.lit("base"), F.transform("x", lambda v: texts.byte_to_unit(F.floor((v + 1) * 100))))
    s = vectors(spark, d).select("vec_id", img.alias("image"), F.create_map(F.lit("base"), F.lit(True)).alias("image_mask"), F.col("x").alias("state"))
    return exploded(observation(s).filter(F.col("image_masks")["base"]).select("vec_id", F.col("images")["base"].alias("a")), "a", "vec_id").withColumn("v", r6("v"))


@query("SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE, 6) AS {n}" for i, n in enumerate([f"{side}_{i}" for side in ("left", "right") for i in range(32)])) + " FROM embeddings")
def prj17_prj19_spread(spark, d):
    s = P.spread(F.col("x"), [("left", 32), ("right", 32)])
    v = vectors(spark, d).withColumn("rollout_id", F.lit(1)).select("vec_id", *s, "rollout_id").drop("rollout_id")
    return v.withColumns({c: r6(c) for c in v.columns[1:]})


SLICE0 = """n AS (SELECT episode, max(t) AS last FROM traj GROUP BY episode), c AS (SELECT a.episode, a.t, k.k AS pos, b.value - a.value AS d FROM traj a JOIN n USING (episode), range(4) k(k), traj b WHERE b.episode = a.episode AND b.t = least(a.t + k.k, n.last)),
s AS (SELECT pos, avg(d) AS mean, stddev_pop(d) AS std FROM c GROUP BY pos)"""


@query("WITH {traj}, " + SLICE0 + " SELECT episode, t, c.pos, round((d - mean) / (std + 1e-6), 6) AS v FROM c JOIN s USING (pos)")
def pipe1_chunk_delta_normalize(spark, d):
    """Episodes, look-ahead, deltas, statistics by position, normalised rows."""
    samples = pipelines.training_frames(traj(spark, d).withColumn("action", F.col("value")), None, 4)
    deltas = samples.select("episode", "t", F.transform("actions", lambda a: a - F.col("value")).alias("x"))
    deltas = shared.staged(deltas, "deltas")  # read twice: for the statistics and for the rows
    from kinelake.operators import aggregates

    moments = aggregates.moments(aggregates.dimensions(deltas, {"actions": F.col("x")}))
    stats = moments.agg(F.array_sort(F.collect_list(F.struct("dim", "mean", "std"))).alias("s")).select("s.mean", "s.std")
    rows = deltas.crossJoin(F.broadcast(stats)).withColumn("a", V.normalize_z(F.col("x"), F.col("mean"), F.col("std")))  # one row of statistics
    return exploded(rows, "a", "episode", "t").withColumn("v", r6("v"))


@query("SELECT vec_id, i - 1 AS pos, round(embedding[i]::DOUBLE, 5) AS v FROM embeddings, range(1, 8) r(i)")
def pipe2_round_trip(spark, d):
    """Inference inputs and then outputs give the actions back."""
    stats = {"actions": {"mean": [0.01] * 7, "std": [0.2] * 7, "q01": [-0.3] * 7, "q99": [0.35] * 7}}
    config = pipelines.robot_config("libero", "flow_state", stats)
    s = vectors(spark, d, 7).select("vec_id", F.col("x").alias("state"), F.array("x").alias("actions"), F.lit("Pick_up ").alias("prompt"))
    got = s.transform(config.training()).transform(config.inference_outputs())
    return exploded(got.select("vec_id", F.slice(F.col("actions")[0], 1, 7).alias("a")), "a", "vec_id").withColumn("v", F.round("v", 5))


@query("SELECT vec_id, 'Task: pick up, State: ' || array_to_string(list_transform(embedding::DOUBLE[], lambda v: floor((v + 1) * 128)::BIGINT), ' ') || ';' || chr(10) AS prompt_text FROM embeddings")
def pipe3_model_inputs(spark, d):
    s = vectors(spark, d).select("vec_id", F.col("x").alias("state"), F.lit(" Pick_Up ").alias("prompt"))
    return s.transform(pipelines.model_inputs("fast", 32)).select("vec_id", "prompt_text")
