"""Robots' configurations over the test tables: the whole way in, and the way back."""

from pyspark.sql import functions as F

from kinelake.plans import robots
from kinelake.plans.registry import query, r6, vectors

def sized_image():
    return F.struct(F.lit(480).alias("height"), F.lit(640).alias("width"), bytes_of(3).alias("data"))


def stats(dims):
    return {k: {"mean": [0.01 * i for i in range(dims)], "std": [0.2 + 0.01 * i for i in range(dims)], "q01": [-0.3 - 0.01 * i for i in range(dims)], "q99": [0.4 + 0.01 * i for i in range(dims)]} for k in ("state", "actions")}


def bytes_of(n):
    """An image as bytes: blank ones are made of it."""
    return F.unhex(F.repeat(F.lit("7f"), n))


def values(df):
    """``vec_id, what, row, pos, v`` of state and actions, and the number of tokens and of images that count."""
    part = lambda what, rows: df.select("vec_id", F.lit(what).alias("what"), F.posexplode(rows).alias("row", "x")).select("vec_id", "what", F.col("row").cast("long").alias("row"), F.posexplode("x").alias("pos", "v"))
    masked = F.size(F.filter(F.map_values("image_mask"), lambda m: m)).cast("double")
    blanks = F.size(F.filter(F.map_values("image"), lambda i: F.hex(i).rlike("^(00)+$"))).cast("double")
    tokens = F.aggregate("token_mask", F.lit(0).cast("long"), lambda a, b: a + b).cast("double")
    out = part("state", F.array("state")).unionByName(part("actions", F.col("actions"))).unionByName(part("counts", F.array(F.array(masked, blanks, tokens))))
    return out.select("vec_id", "what", "row", F.col("pos").cast("long").alias("pos"), r6("v").alias("v"))


def counts_sql(masked, blanks, tokens):
    return f" UNION ALL SELECT vec_id, 'counts', 0, i, [{masked}::DOUBLE, {blanks}, ({tokens})::DOUBLE][i + 1] FROM embeddings, range(3) r(i)"


def padded(cell, dims, filled=0.0):
    """SQL: a normalised cell, or what fills the vector to 32."""
    return f"round(CASE WHEN i < {dims} THEN {cell} ELSE {filled}::DOUBLE END, 6)"


Q = "(({x}) - (-0.3 - 0.01 * i)) / (0.7 + 0.02 * i + 1e-6) * 2 - 1"
Z = "(({x}) - 0.01 * i) / (0.2 + 0.01 * i + 1e-6)"


@query("SELECT vec_id, 'state' AS what, 0 AS row, i AS pos, " + padded(Z.format(x="embedding[i + 1]::DOUBLE"), 8) + " AS v FROM embeddings, range(32) r(i) UNION ALL SELECT vec_id, 'actions', k, i, "
       + padded(Z.format(x="embedding[i + 1 + k]::DOUBLE - CASE WHEN i < 6 THEN embedding[i + 1]::DOUBLE ELSE 0 END"), 7) + " FROM embeddings, range(32) r(i), range(2) x(k)" + counts_sql(2, 1, "7"))
def pipe4_libero(spark, d):
    s = vectors(spark, d).select("vec_id", F.slice("x", 1, 8).alias("state"), F.array(F.slice("x", 1, 7), F.slice("x", 2, 7)).alias("actions"), bytes_of(12).alias("image"), bytes_of(5).alias("wrist_image"), F.lit("pick_up ").alias("prompt"), F.lit("gone").alias("other"))
    return values(s.transform(robots.robot_config("libero", "flow", stats(8)).training()))


@query("SELECT vec_id, 'state' AS what, 0 AS row, i AS pos, round(" + Q.format(x="embedding[i + 1]::DOUBLE") + ", 6) AS v FROM embeddings, range(8) r(i) UNION ALL SELECT vec_id, 'actions', k, i, round("
       + Q.format(x="embedding[i + 1 + k]::DOUBLE - CASE WHEN i < 7 THEN embedding[i + 1]::DOUBLE ELSE 0 END") + ", 6) FROM embeddings, range(8) r(i), range(2) x(k)" + counts_sql(3, 1, "4"))
def pipe5_droid_positions(spark, d):
    """For the fast model, with a tokenizer of one's own: four tokens of any prompt."""
    from kinelake.plans.pipelines import register_tokenizer

    register_tokenizer("four", lambda text: F.array_repeat(F.char_length(text) * 0 + 1, 4))
    o = F.struct(bytes_of(12).alias("image"), bytes_of(5).alias("wrist_image"), F.slice("x", 1, 7).alias("joint_position"), F.col("x")[7].alias("gripper_position"))
    s = vectors(spark, d).select("vec_id", o.alias("observation"), F.array(F.slice("x", 1, 8), F.slice("x", 2, 8)).alias("actions"), F.lit("Pick").alias("prompt"))
    return values(s.transform(robots.robot_config("droid_rlds", "fast", stats(8), tokenizer="four", most_tokens=300).training()))


@query("SELECT vec_id, k AS row, i AS pos, round(embedding[i + 1 + k]::DOUBLE, 5) AS v FROM embeddings, range(8) r(i), range(2) x(k)")
def pipe6_droid_round_trip(spark, d):
    """Velocities: the way in and the way back give the robot's own eight dimensions."""
    s = vectors(spark, d).select("vec_id", *(bytes_of(3).alias(c) for c in ("exterior_image_1_left", "exterior_image_2_left", "wrist_image_left")), F.slice("x", 1, 7).alias("joint_position"), F.slice("x", 8, 1).alias("gripper_position"), F.array(F.slice("x", 1, 8), F.slice("x", 2, 8)).alias("actions"), F.lit("go").alias("prompt"))
    config = robots.robot_config("droid", "flow_state", stats(8))
    got = s.transform(config.training()).transform(config.inference_outputs())
    return got.select("vec_id", F.posexplode("actions").alias("row", "a")).select("vec_id", F.col("row").cast("long").alias("row"), F.posexplode("a").alias("pos", "v")).select("vec_id", "row", F.col("pos").cast("long").alias("pos"), F.round("v", 5).alias("v"))


@query("SELECT vec_id, k AS row, i AS pos, round(embedding[i + 1 + k]::DOUBLE, 5) AS v FROM embeddings, range(14) r(i), range(2) x(k)")
def pipe7_aloha_round_trip(spark, d):
    """Two arms, one wrist camera, deltas, flipped joints, and grippers that leave and return by different ways."""
    own = F.array(F.slice("x", 1, 14), F.slice("x", 2, 14))
    o = F.struct(F.struct(sized_image().alias("top")).alias("images"), F.slice("x", 1, 14).alias("state"))
    s = vectors(spark, d).select("vec_id", o.alias("observation"), own.alias("action"), F.lit("fold").alias("prompt"))
    config = robots.robot_config("aloha", "flow_state", stats(14))
    got = s.transform(config.training())
    back = got.transform(config.inference_outputs())
    return back.filter(F.col("image_fit")["base_0_rgb"]["height"] == 168).select("vec_id", F.posexplode("actions").alias("row", "a")).select("vec_id", F.col("row").cast("long").alias("row"), F.posexplode("a").alias("pos", "v")).select("vec_id", "row", F.col("pos").cast("long").alias("pos"), F.round("v", 5).alias("v"))
