"""Datasets of episodes, their metadata, ranges and evaluation shards, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODES = "episode_index bigint, tasks array<string>, length bigint"
TASKS = "task_index bigint, task string"
RANGES = "map<string,array<array<int>>>"
SHARD = "map<string,struct<total_count:bigint,success_count:bigint>>"


def frames(spark: SparkSession, root: str) -> DataFrame:
    """Frames of a dataset: parquet files by chunk below ``data``."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/data")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines give no rows."""
    return spark.read.schema(schema).json(path)


def episodes(spark: SparkSession, root: str) -> DataFrame:
    return json_lines(spark, f"{root}/meta/episodes.jsonl", EPISODES)


def tasks(spark: SparkSession, root: str) -> DataFrame:
    return json_lines(spark, f"{root}/meta/tasks.jsonl", TASKS)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, value``: a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def parse_ranges(text: Column) -> Column:
    return F.from_json(text, RANGES)


def ranges(files: DataFrame) -> DataFrame:
    """``key, start, end`` of range files: a row a half-open range."""
    by_key = files.select(F.explode(parse_ranges(F.col("value"))).alias("key", "list"))
    return by_key.select("key", F.explode("list").alias("r")).select("key", F.col("r")[0].cast("long").alias("start"), F.col("r")[1].cast("long").alias("end"))


def shards(files: DataFrame) -> DataFrame:
    """``suite, start, end, category, total_count, success_count`` of files ``<suite>/<start>_<end>.json``."""
    name = r"([^/]+)/(\d+)_(\d+)\.json$"
    some = files.filter(F.col("path").rlike(name))
    rows = some.select(F.regexp_extract("path", name, 1).alias("suite"), *(F.regexp_extract("path", name, i).cast("long").alias(c) for i, c in ((2, "start"), (3, "end"))), F.explode(F.from_json("value", SHARD)).alias("category", "c"))
    return rows.select("suite", "start", "end", "category", F.coalesce("c.total_count", F.lit(0)).alias("total_count"), F.coalesce("c.success_count", F.lit(0)).alias("success_count"))


def recorded_steps(files: DataFrame) -> DataFrame:
    """Recorded steps by number, not by name: ``step`` of ``step_<i>``."""
    return files.withColumn("step", F.regexp_extract("path", r"step_(\d+)", 1).cast("long"))


def equal_lengths(df: DataFrame, *arrays: str) -> DataFrame:
    """``df`` if in each row all arrays are equally long; else an error."""
    sizes = F.array(*(F.size(c) for c in arrays))
    bad = F.raise_error(F.lit("arrays of an episode differ in length"))
    return df.filter(F.when(F.array_min(sizes) == F.array_max(sizes), F.lit(True)).otherwise(bad.cast("boolean")))


def fake_samples(spark: SparkSession, n: int, dims: dict[str, tuple[str, int]]) -> DataFrame:
    """``n`` samples that depend on index and name alone: floats in [-1, 1), ints in [0, 2048), else zeros."""

    def column(name: str, kind: str, size: int) -> Column:
        def at(i: Column) -> Column:
            h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("index").cast("string"), i.cast("string"), F.lit(name))), 1, 6), 16, 10).cast("long")
            return h / float(1 << 23) - 1.0 if kind == "float" else F.pmod(h, F.lit(2048)).cast("long") if kind == "int" else F.lit(0).cast("long")

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at).alias(name)

    return spark.range(n).withColumnRenamed("id", "index").select("index", *(column(k, *v) for k, v in dims.items()))


def first_rule(age_of: Column, rules: list[tuple[str, int]]) -> Column:
    """The expiry of a path: that of the first pattern that matches."""
    out = F.lit(None).cast("long")
    for pattern, expiry in reversed(rules):
        out = F.when(age_of.rlike(pattern), F.lit(expiry).cast("long")).otherwise(out)
    return out


#: A sample as models take it; images are bytes with their size beside them.
SAMPLE = "image map<string,binary>, image_mask map<string,boolean>, state array<float>, tokenized_prompt array<int>, tokenized_prompt_mask array<boolean>, token_ar_mask array<int>, token_loss_mask array<boolean>, actions array<array<float>>"


def observation(df: DataFrame) -> DataFrame:
    """Samples as observations: ``images``, ``image_masks``, ``state`` and prompt; prompt and mask come together or not at all."""
    for name in ("image", "image_mask", "state"):
        if name not in df.columns:
            raise ValueError(f"{name} is required")
    if ("tokenized_prompt" in df.columns) != ("tokenized_prompt_mask" in df.columns):
        raise ValueError("a tokenized prompt needs its mask, and a mask its prompt")
    return df.withColumnsRenamed({"image": "images", "image_mask": "image_masks"})
