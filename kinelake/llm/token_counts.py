"""Token counts by a map-side, two-tier lookup.

A text's tokens are those of its pre-tokens, so its count is a sum of lengths.
Tier one is a compact hash table that is broadcast once: the lengths of the
``table_entries`` most frequent pre-tokens in a sample of ``sample_rows``
documents, the first that Spark finds; its texts (64 KB each at most) reach the
driver. The sample decides what is looked up
quickly, never what is counted. Tier two is a cache in each Python worker: a
pre-token that the table lacks is encoded once by the library and kept; the
cache is emptied when it holds ``cache_entries``. No pre-token is ever shuffled,
and the plan is a scan and a map.

Pre-tokens are found with the pattern of byte-level vocabularies, written out
for the characters of everyday texts. Texts with any other character (controls,
marks, rare scripts) or with a special string go to the library whole, as do
all texts if the file splits or normalises them in another way, so counts are
the library's for every text and every file.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions.pieces import PATTERN, PLAIN, loaded, specials, splits_by_pattern, written
from kinelake.llm import common

SAMPLE_BYTES = 1 << 16


def frequent(texts: list[str], entries: int) -> list[str]:
    """The pre-tokens (of 64 characters at most) that are most frequent in a few ``texts``."""
    found: Counter[str] = Counter()
    for text in texts:
        if PLAIN.fullmatch(text):
            found.update(p for p in PATTERN.findall(text) if len(p) <= 64)
    return [p for p, _ in found.most_common(entries)]


def sample(docs: DataFrame, rows: int) -> list[str]:
    """The first ``rows`` texts of ``SAMPLE_BYTES`` at most that Spark finds; it reads no more partitions than it needs."""
    return [r["text"] for r in docs.filter(F.octet_length("text") <= SAMPLE_BYTES).select("text").take(rows)]


def lengths_of(spec: str, pieces: list[str]) -> dict[str, int]:
    """Tier one: the number of tokens of each pre-token."""
    encode = loaded(spec).model.tokenize
    return {p: len(encode(written(p))) for p in pieces}


class Lengths(dict):
    """The broadcast table, with the worker's own cache behind it."""

    def __init__(self, table: dict[str, int], tok, cache_entries: int):
        super().__init__(table)
        self.table, self.encode, self.most = table, tok.model.tokenize, len(table) + cache_entries

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.table)
        self[piece] = n = len(self.encode(written(piece)))
        return n


_worker: dict[str, tuple] = {}


def _lookup(key: str, spec, table, cache_entries: int) -> tuple:
    """The tokenizer, its special strings and the lengths of this worker process."""
    if key not in _worker:
        tok = loaded(spec)
        _worker.clear()
        _worker[key] = tok, specials(spec), splits_by_pattern(spec) and Lengths(table, tok, cache_entries)
    return _worker[key]


def counter(key: str, spec, table, cache_entries: int):
    """A function from a text to its number of tokens."""
    tok, special, lengths = _lookup(key, spec, table, cache_entries)
    if lengths is False:
        return lambda text: len(tok.encode(text, add_special_tokens=False).ids)
    findall, length, plain, found = PATTERN.findall, lengths.__getitem__, PLAIN.fullmatch, special.search

    def count(text: str) -> int:
        if not plain(text) or found(text):
            return len(tok.encode(text, add_special_tokens=False).ids)
        return sum(map(length, findall(text)))

    return count


def token_counts(df: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", cache_entries: int = 1_000_000, table_entries: int = 50_000, sample_rows: int = 1000) -> DataFrame:
    """Tokens of every whole text: ``doc_id, n_bytes, n_tokens``.

    ``tokenizer_path``: a BPE file for the tokenizers library, on the driver; the
    two tiers serve byte-level ones. Null and empty texts have 0 bytes and 0 tokens; repeated rows give
    repeated rows; an empty table gives none; other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    docs = common.documents(df, id_col, text_col)
    pieces = frequent(sample(docs, sample_rows), table_entries) if splits_by_pattern(spec) else []
    b = df.sparkSession.sparkContext.broadcast((spec, lengths_of(spec, pieces)))
    key = f"{hash(spec)}:{hash(tuple(pieces))}:{cache_entries}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(key, *b.value, cache_entries)
        for batch in batches:
            n = [count(t) for t in common.each(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    docs = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
