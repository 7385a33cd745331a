"""Exact duplicates through an extendible-hash index on shared files.

* Keys: a 64-bit hash of each text, counted. Everything that plans the index
  reads these counts, not texts.
* Directory: buckets are ranges of keys. It starts with one bucket and is
  doubled while any bucket holds more distinct keys than ``capacity``; buckets
  that fit keep their shorter prefix, so several slots of the directory name
  the same bucket.
* Owners: the directory deals rows out, a bucket to one task. The owner sorts
  its buckets by key, chains what has one key, and compares the texts of a chain
  byte by byte. It writes its buckets to the shared folder, in order of bucket
  and key: the index.
* Keys with over a thousandth of all rows (so a thousand at most) aren't dealt
  out, as one owner would get a third of the corpus: their texts are compared
  and counted where they stand, combined on the map side, and the few chains
  that result are broadcast back to their rows.

Only DataFrame functions run on the data.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm import common

#: The directory has at most two to this power slots; beyond them buckets grow, and their owners spill.
MOST_DEPTH = 18


def prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def grow_directory(keys: DataFrame, capacity: int) -> list[int]:
    """The bucket of each of the directory's 2^depth slots, from distinct ``key``.

    A histogram over prefixes, a few bits longer than evenly spread keys need,
    says how full a bucket of any depth is; it is taken again with longer ones
    while that doesn't do (2^MOST_DEPTH rows at most, whatever the data).
    """
    seen = min(MOST_DEPTH, (keys.count() // capacity).bit_length() + 3)
    while True:
        fine = {r["p"]: r["count"] for r in keys.groupBy(prefix(F.col("key"), seen).alias("p")).count().collect()}
        upto = [0, *accumulate(fine.get(p, 0) for p in range(2**seen))]
        slots, depth = [(0, 0)], 0  # (local depth, prefix)

        def is_over(local: int, p: int) -> bool:
            step = seen - local  # noqa: B023
            return upto[(p + 1) << step] - upto[p << step] > capacity  # noqa: B023

        while depth < seen and (over := {s for s in set(slots) if is_over(*s)}):
            depth += 1
            slots = [(s[0] + 1, 2 * s[1] + bit) if s in over else s for s in slots for bit in (0, 1)]
        if seen == MOST_DEPTH or not any(is_over(*s) for s in set(slots)):
            break
        seen = min(MOST_DEPTH, seen + 3)
    order = {s: i for i, s in enumerate(dict.fromkeys(slots))}
    return [order[s] for s in slots]


def bucket(key: Column, directory: list[int]) -> Column:
    depth = len(directory).bit_length() - 1
    slots = F.split(F.lit(",".join(map(str, directory))), ",").cast("array<int>")
    return F.element_at(slots, (prefix(key, depth) + 1).cast("int"))


def build_index(docs: DataFrame, directory: list[int]) -> DataFrame:
    """``bucket, key, doc_id, sha, keep_id, group_size`` of ``doc_id, key, text``: each bucket sorted by one owner."""
    chain = Window.partitionBy("bucket", "key", "text")
    owned = docs.withColumn("bucket", bucket(F.col("key"), directory)).repartition("bucket")
    owned = owned.select("bucket", "key", "doc_id", sha256(), F.max("doc_id").over(chain).alias("keep_id"), F.count("*").over(chain).alias("group_size"))
    return common.staged(owned, "index")


def sha256() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("sha")


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1000) -> DataFrame:
    """One row a document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null counts as empty. The largest id
    of a group stays. Of rows that repeat both id and text all count in
    ``group_size`` and all are kept or dropped alike. A row without an id stays
    only if no equal text has one. An empty table gives no rows; columns other
    than the two are not read. ``capacity``: distinct keys in a bucket.
    """
    docs = common.documents(df, id_col, text_col).withColumn("key", F.xxhash64("text"))
    keys = common.staged(docs.groupBy("key").agg(F.count("*").alias("n")), "keys")
    directory = grow_directory(keys, capacity)

    large = common.large_enough(keys.agg(F.sum("n")).first()[0] or 0)
    hot = F.broadcast(keys.filter(F.col("n") >= large).select("key"))  # a thousand at most
    index = build_index(docs.join(hot, "key", "left_anti"), directory)

    same = docs.join(hot, "key")
    chains = same.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).select("key", sha256(), "keep_id", "group_size")
    chains = common.staged(chains, "chains")
    found = same.select("doc_id", "key", sha256()).join(F.broadcast(chains), ["key", "sha"])  # a thousand keys at most

    columns = ["doc_id", "sha", "keep_id", "group_size"]
    return index.select(*columns).unionByName(found.select(*columns)).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.read(spark, sf_dir, "documents"))


OP2_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
