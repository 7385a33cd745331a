"""What the operators share: staging tables in the shared folder, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.sources.shared import new_path, shared_dir, ship, small_batches, staged  # noqa: F401

#: White space between words: the space and U+0009 to U+000D. ``bytes.split()`` splits on just these.
WORD = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> None:
    """Sends the package to executors, and keeps batches of whole texts small: some are very long."""
    ship(spark)
    small_batches(spark)


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just the columns ``doc_id`` and ``text`` (null: empty); other columns can't clash."""
    prepare(df.sparkSession)
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hashes(h: np.ndarray, k: int, salt: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every ``k`` consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g, m = np.zeros(n, np.uint64), np.uint64(salt | 1)
    for i in range(k):
        g *= m
        g += h[i : i + n]
    return mix64(g)


def join_hot(left: DataFrame, right: DataFrame, key: list[str], hot: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, whose rows of distinct ``key`` for which ``hot`` holds are few by construction.

    Those are broadcast, so that the many rows of ``left`` that share one stay where they are; the rest meet by key.
    """
    few, rest = F.broadcast(right.filter(hot)), right.filter(~hot)
    return left.join(few, key).unionByName(left.join(few.select(*key), key, "left_anti").join(rest, key, how), allowMissingColumns=True)


def only(df: DataFrame, ids: DataFrame, key: str, most: int = 200_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the table ``ids`` (one column, distinct).

    Up to ``most`` ids, which is counted, are broadcast and ``df`` isn't moved; more meet it by key.
    """
    return df.join(F.broadcast(ids) if ids.count() <= most else ids.hint("shuffle_hash"), key, "left_semi")


def free(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name in have:
        name = f"_{name}"
    return name


def threshold(wanted: int, rows: int) -> int | None:
    """Of ``rows`` signed 64-bit hashes, about ``wanted`` are less than this; none: all are taken."""
    return None if wanted >= rows else wanted * 2**64 // rows - 2**63


def below(hash_col: Column | str, wanted: int, rows: int) -> Column:
    """Whether a row's 64-bit hash is among about ``wanted`` of ``rows``."""
    t = threshold(wanted, rows)
    return F.lit(True) if t is None else F.col(hash_col) < F.lit(t).cast("long") if isinstance(hash_col, str) else hash_col < F.lit(t).cast("long")


def drawn(key: str, wanted: int, rows: int) -> Column:
    """Whether a row's key is among about ``wanted`` of ``rows``, by its hash."""
    return below(F.xxhash64(key), wanted, rows)


def without(df: DataFrame, gone: DataFrame, same: Column, most: int = 200_000) -> DataFrame:
    """``df`` but the rows for which ``same`` holds with a row of the table ``gone``.

    Up to ``most`` rows of that, which are counted, are broadcast and ``df`` isn't moved; more meet it by key.
    """
    return df.join(F.broadcast(gone) if gone.count() <= most else gone.hint("shuffle_hash"), same, "left_anti")


def each(column: pa.Array) -> Iterator:
    """The values of a column, of which few are Python's at a time."""
    for i in range(0, len(column), 256):
        yield from column.slice(i, 256).to_pylist()


def runs_of_keys(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows that agree in the first ``keys`` columns (whole numbers), of sorted batches, a table at a time."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(edges, edges[1:], strict=False):
            if held and tuple(k[:, i]) != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(i, j - i))
            last = tuple(k[:, i])
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def large_enough(rows: int, share: int = 1000, least: int = 1000) -> int:
    """From so many rows on, a group counts as hot; no more than ``share`` groups can be."""
    return max(least, -(-rows // share))


_M = np.uint64(0x9E3779B97F4A7C15)
_M_INVERSE = np.uint64(pow(int(_M), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse, up to ``n`` at least."""
    if len(_powers[0]) <= n:
        for i, m in enumerate((_M, _M_INVERSE)):
            p = np.full(2 * n + 2, m)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words ``start`` to ``end`` (without it) for each pair; equal words, equal hash."""
    up, down = _tables(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
