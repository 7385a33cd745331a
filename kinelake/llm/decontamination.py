"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-cased words. A document and a benchmark item become
a pair if they share a seed of ``SEED`` words. On each pair, the longest match
between words that no tile covers yet becomes a tile, again and again, until
none has the seed's length. Running Karp-Rabin hashes tell whether there are
matches of a given length; the greatest such length is found by bisection, and
all tiles of that length are marked at once, so texts that repeat one word cost
no more than others. As tiles may come in any order, reordered passages are
found as well. The share of the item's words under tiles is its coverage.

Every window of a seed's length inside a tile is a shared seed, so the words of
an item under shared seeds are a bound of its coverage. Pairs are tiled only
where that reaches what is asked for, so openings that many items share cost
little.

The benchmark is cut into blocks of about ``BLOCK_BYTES`` by a hash of ids and texts.
One at a time is broadcast; the documents are scanned once for each block. A
benchmark of any size is thus covered in full, memory holds a block, and
documents never move.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import common

SEED, BLOCK_BYTES = 5, 16 << 20
_WORDS = re.compile(r"\w+").findall


def windows(hashes: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and Karp-Rabin hashes of the windows in which every word is free."""
    marked = np.r_[0, np.cumsum(~free)]
    at = np.flatnonzero(marked[length:] == marked[: len(marked) - length]) if len(free) >= length else np.empty(0, np.int64)
    return at, common.range_hashes(hashes, at, at + length)


def matches(doc, item, free_doc, free_item, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the document that equal one of the item, and the item's own, with their hashes."""
    j, of_item = windows(item, free_item, length)
    i, of_doc = windows(doc, free_doc, length)
    hit = np.isin(of_doc, of_item)
    return i[hit], of_doc[hit], j, of_item


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in doc, start in item, length) of ``least`` words and more, longest first, then by start."""
    free_doc, free_item, found = np.ones(len(doc), bool), np.ones(len(item), bool), []
    most = min(len(doc), len(item))  # no match is longer
    while most >= least:
        low, high, at = least - 1, most, None  # a match of ``low`` words exists, or none at all
        while low < high:
            middle = (low + high + 1) // 2
            now = matches(doc, item, free_doc, free_item, middle)
            if len(now[0]):
                low, at = middle, now
            else:
                high = middle - 1
        if at is None:
            break
        places = defaultdict(list)
        for j, h in zip(at[2].tolist(), at[3].tolist(), strict=True):
            places[h].append(j)
        after, taken = 0, 0  # where the next tile may start; the item's words taken in this round
        for i, h in zip(at[0].tolist(), at[1].tolist(), strict=True):
            if i < after:
                continue
            own = places[h]
            while own and not (free_item[own[0] : own[0] + low].all() and np.array_equal(doc[i : i + low], item[own[0] : own[0] + low])):
                own.pop(0)  # taken for good, as are those before it
            if own:
                j = own.pop(0)
                free_doc[i : i + low] = free_item[j : j + low] = False
                found.append((i, j, low))
                after, taken = i + low, taken + low
        if not taken:  # only where hashes collide
            return found
        most = low - 1
    return found


class Index:
    """A block of the benchmark: its words, and the items that have each seed."""

    def __init__(self, items: list[tuple]):
        self.number: dict[str, int] = {}
        self.ids = [item for item, _ in items]
        self.items = {}  # by place in the block, as ids may repeat or lack
        places: dict[int, list[tuple]] = defaultdict(list)  # by the seed's length: hashes, items, and where in the item
        for item, (_, text) in enumerate(items):
            words = [self.number.setdefault(w, len(self.number) + 1) for w in _WORDS((text or "").lower())]
            if words:
                self.items[item] = own = np.array(words, np.uint64)
                k = min(SEED, len(own))
                grams = common.gram_hashes(own, k)
                places[k].append((grams, np.full(len(grams), item), np.arange(len(grams))))
        self.seeds = {}
        for k, found in places.items():
            grams, item, at = map(np.concatenate, zip(*found, strict=True))
            order = np.lexsort((at, item, grams))
            hashes, first = np.unique(grams[order], return_index=True)
            self.seeds[k] = hashes, np.r_[first, len(order)], item[order], at[order]

    def reached(self, item: np.ndarray, place: np.ndarray, k: int, least: float) -> list[int]:
        """The items of which shared seeds (item, where in it) lie over a share of ``least`` or more."""
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        begins = np.r_[True, item[1:] != item[:-1]]
        gap = np.r_[np.where(begins[1:], k, np.minimum(place[1:] - place[:-1], k)), k]  # words under a seed before the next one starts
        first = np.flatnonzero(begins)
        words = np.add.reduceat(gap, first)
        sizes = np.array([len(self.items[i]) for i in item[first].tolist()])
        return item[first][words >= least * sizes - 1e-9].tolist()

    def covered(self, text: str, least: float) -> list[tuple]:
        """(item, coverage, tiles) of the items of which ``text`` covers a share of ``least`` or more."""
        get = self.number.get
        doc = np.array([get(w, 0) for w in _WORDS(text.lower())], np.uint64)
        hits: dict[int, tuple] = {}  # item: where its seeds start in the document, and their length
        for k, (hashes, first, item_of, place) in self.seeds.items():
            if len(doc) < k:
                continue
            grams = common.gram_hashes(doc, k)
            at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
            start = np.flatnonzero(hashes[at] == grams)
            if not len(start):
                continue
            seed = at[start]
            shared = np.unique(seed)
            sizes = first[shared + 1] - first[shared]
            entry = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - first[shared], sizes)
            for item in self.reached(item_of[entry], place[entry], k, least):
                own = np.isin(grams[start], common.gram_hashes(self.items[item], k))
                hits[item] = start[own], k
        found = []
        for item in sorted(hits):
            own = self.items[item]
            # Only words under seeds can be in tiles; a 0 parts those that aren't neighbours.
            near = np.zeros(len(doc) + 2, np.int64)
            start, k = hits[item]
            near[start] += 1
            near[start + k] -= 1
            inside = near.cumsum()[:-1] > 0
            doc0 = np.r_[doc, np.uint64(0)]
            keep = inside | np.r_[False, inside[:-1]]
            t = tiles(np.where(inside, doc0, np.uint64(0))[keep], own, min(SEED, len(own)))
            if (share := sum(k for _, _, k in t) / len(own)) >= least:
                found.append((self.ids[item], share, len(t)))
        return found


def contaminated(df: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = 0.5) -> DataFrame:
    """A row for each document and item of which it covers ``least`` or more: ``doc_id, item_id, coverage, tiles``.

    Null and empty texts, and items without words, match nothing; an item of
    fewer words than a seed must occur whole. Repeated documents give repeated
    rows; repeated items count once, and texts that share an item's id by themselves;
    an empty table on either side gives none, and a document that covers no item
    so far has no row; other columns are not read.
    """
    spark = df.sparkSession
    docs = common.documents(df, id_col, text_col)
    items = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text_col].alias("text")).distinct()
    kinds = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, tiles int"
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)

    def scan(block: int) -> DataFrame:
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        shared = spark.sparkContext.broadcast([tuple(r) for r in own])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                rows = [(d, *f) for d, t in zip(*map(common.each, batch.columns), strict=True) for f in index.covered(t, least)]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "coverage", "tiles"])

        found = docs.mapInArrow(run, schema)
        if blocks == 1:
            return found
        found = common.staged(found, "covered")  # done before the next block is loaded
        shared.destroy()
        return found

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema)).types
    return reduce(DataFrame.unionByName, map(scan, range(blocks))) if blocks else spark.createDataFrame([], schema)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
