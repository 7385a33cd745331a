"""The registry of queries: name, function of (spark, sf_dir), and SQL where it can be said in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinelake.sources.shared import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Episodes of the test tables: the events of a user, in order of time.
TRAJ = """traj AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
  value, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k, event_id, event_type, ts FROM events)"""


def query(sql: str | None = None):
    """Registers a function under its name. ``{traj}`` in SQL stands for the episodes."""

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql.replace("{traj}", TRAJ)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes; the key has its name before it is shuffled by, so that later windows share the shuffle."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("episode"), "value", k.alias("k"), "event_id", "event_type", "ts")
    t = F.row_number().over(Window.partitionBy("episode").orderBy("ts", "event_id")) - 1
    return e.withColumn("t", t.cast("long")).select("episode", "t", "value", "k", "event_id", "event_type", "ts")


def vectors(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """``vec_id, label, x``: embeddings as doubles, the first ``n`` dimensions."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), (F.slice(x, 1, n) if n else x).alias("x"))


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def exploded(df: DataFrame, array: str, *keys: str) -> DataFrame:
    """An array as rows ``keys, pos, v``."""
    return df.select(*keys, F.posexplode(array).alias("pos", "v")).select(*keys, long("pos").alias("pos"), "v")
