"""Writers: datasets by chunk, metadata, statistics, summaries."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinelake.operators import aggregates

CHUNK = 1000


def chunk(episode: Column, size: int = CHUNK) -> Column:
    return F.floor(episode / size).cast("long")


def data_path(episode: Column) -> Column:
    """``data/chunk-000/episode_000000.parquet``"""
    return F.format_string("data/chunk-%03d/episode_%06d.parquet", chunk(episode), episode)


def write_frames(frames: DataFrame, root: str) -> None:
    """Rewritten frames, partitioned by chunk: a range of episodes a file, sorted, so readers skip by statistics."""
    dealt = frames.withColumn("chunk", chunk(F.col("episode_index"))).repartitionByRange("episode_index")
    dealt.sortWithinPartitions("episode_index", "index").write.partitionBy("chunk").parquet(f"{root}/data")


def renumbered(frames: DataFrame, numbers: DataFrame) -> DataFrame:
    """Frames with new ``episode_index`` and ``index`` in their old places. ``numbers``: ``old, new, offset``."""
    place = F.row_number().over(Window.partitionBy("episode_index").orderBy("frame_index")) - 1
    joined = frames.join(numbers, F.col("episode_index") == F.col("old"))
    new = {"episode_index": F.col("new"), "index": F.col("offset") + place}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in frames.columns))


def metadata(episodes: DataFrame, tasks: DataFrame) -> dict:
    """Totals for ``info.json``: one row reaches the driver."""
    e = episodes.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("frames")).first()
    n = e["n"]
    return {"total_episodes": n, "total_frames": e["frames"], "total_tasks": tasks.count(), "total_chunks": -(-n // CHUNK), "splits": {"train": f"0:{n}"}}


def write_metadata(episodes: DataFrame, tasks: DataFrame, root: str, info: dict | None = None) -> dict:
    """``episodes.jsonl``, ``tasks.jsonl`` as folders of JSON lines, and ``info.json``."""
    episodes.write.json(f"{root}/meta/episodes.jsonl")
    tasks.write.json(f"{root}/meta/tasks.jsonl")
    full = (info or {}) | metadata(episodes, tasks)
    write_text(episodes, json.dumps(full, indent=4), f"{root}/meta/info.json")
    return full


def write_text(df: DataFrame, text: str, path: str) -> None:
    """One small text, through Spark, so any file system will do."""
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def write_norm_stats(stats: DataFrame, path: str) -> None:
    write_text(stats, aggregates.norm_stats_json(stats), path)


def read_norm_stats(spark, path: str) -> dict:
    try:
        rows = spark.read.text(path, wholetext=True).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    return json.loads("".join(r[0] for r in rows))["norm_stats"]


def numbered_frames(steps: DataFrame, *, order: str, key: str) -> DataFrame:
    """Appended frames: ``episode_index`` by ``order`` of episodes, ``frame_index`` within each."""
    episodes = steps.groupBy(key).agg(F.min(order).alias("__first"))
    numbers = aggregates.dense_positions(episodes, ["__first", key]).select(key, F.col("pos").alias("episode_index"))
    within = (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long")
    return steps.withColumn("frame_index", within).join(numbers, key)


def next_number(names: DataFrame, pattern: str, column: str = "name") -> DataFrame:
    """One more than the largest number in names of a pattern; 0 without any."""
    n = F.regexp_extract(F.col(column), pattern, 1)
    return names.agg((F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(-1)) + 1).alias("next"))


def summary_json(sums: DataFrame) -> DataFrame:
    """A row with the summary's JSON, categories in display order."""
    c = aggregates.category_summary(sums).withColumn("rank", aggregates.category_rank(F.col("category")))
    rows = F.array_sort(F.collect_list(F.struct("rank", "category", "total", "success", "micro", "macro")))
    return c.agg(F.to_json(F.struct(F.transform(rows, lambda r: F.struct(*(r[x].alias(x) for x in ("category", "total", "success", "micro", "macro")))).alias("per_category"))).alias("json"))
