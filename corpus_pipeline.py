"""A training corpus from ``documents``, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor
kept, and returns what it keeps itself; ``run`` writes that as a table in the
shared folder and reads it again, so a lost executor costs a stage at most.

A stage decides about rows, not ids: rows without an id or with one that repeats
are told apart by their texts, and rows that repeat both are kept or dropped
alike. Null texts count as empty. Other columns, whatever their names, pass
through as they are; an empty table gives an empty one. What is dropped is
broadcast if it is counted to be small; else rows meet it by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import common
from kinelake.llm.decontamination import contaminated
from kinelake.llm.exact_dedup import exact_dedup
from kinelake.llm.language import held_out_fold, identify
from kinelake.llm.mixing import mixed
from kinelake.llm.near_dedup import near_dedup

#: Smallest share of the main language, and similarity of near duplicates in per cent.
LEAST_SHARE, PERCENT = 0.3, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts, too), and those in which no language has ``LEAST_SHARE``.

    If no row has a language to learn from, nothing is identified and nothing stays.
    """
    lang, share = common.free(docs, "main_lang"), common.free(docs, "main_share")
    found = identify(docs, docs.filter(F.coalesce(~held_out_fold(F.col("doc_id")), F.lit(True))), names=(lang, share))
    return found.filter((F.col(lang) != "und") & (F.col(share) >= LEAST_SHARE)).select(*docs.columns)


def _sha(docs: DataFrame) -> Column:
    return F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays; one without an id only if none has one."""
    found = exact_dedup(docs).filter("NOT kept")
    gone = common.staged(found.select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__sha")).distinct(), "gone")
    return common.without(docs, gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (_sha(docs) == gone["__sha"]))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the one with the smallest id stays; one without an id only if none has one."""
    # Where every row has an id of its own, that is its key; else id and text are.
    unique = docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty()
    key = docs["doc_id"] if unique else _key(docs)
    found = near_dedup(docs.select(key.alias("doc_id"), "text"), percent=PERCENT).filter("NOT kept")
    gone = common.staged(found.select(F.col("doc_id").alias("__key")).distinct(), "gone")
    return common.without(docs, gone, key == gone["__key"])


def _key(docs: DataFrame) -> Column:
    """25 bytes, never null, that sort by id and then by 128 bits of the text's SHA-256; null ids come last."""
    i = F.lpad(F.hex(docs["doc_id"].cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    sha = F.substring(F.sha2(F.coalesce(docs["text"], F.lit("")), 256), 1, 32)
    return F.unhex(F.concat(F.when(docs["doc_id"].isNull(), "01" + "0" * 16).otherwise(F.concat(F.lit("00"), i)), sha))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that cover half of any benchmark item, which the text alone decides."""
    found = contaminated(docs.select(_sha(docs).alias("doc_id"), "text"), common.read(spark, sf_dir, "benchmark"))
    gone = common.staged(found.select(F.col("doc_id").alias("__sha")).distinct(), "gone")
    return common.without(docs, gone, _sha(docs) == gone["__sha"])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often: ``copies``, in place of a column of that name."""
    return mixed(docs)


STAGES = [("language ID", language_id), ("exact dedup", exact), ("MinHash near-dedup", near), ("benchmark decontamination", decontaminate), ("mixing", mix)]

#: SQL can't express language ID; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
