"""Repeated passages by relative Lempel-Ziv parsing against an index of reference blocks.

A window is ``length`` consecutive words; a word goes if a window over it also
starts earlier (smaller id, or earlier in its document).

Index. Each window names one anchor: the smallest hash among its ``GRAM``-word
grams. As that depends on the window's words alone, equal windows have equal
anchors at equal offsets. Neighbouring windows with one anchor form a block,
about one for each eight words. A document is thus cut into overlapping blocks,
wherever its text stands. Blocks are indexed by anchor and by the hash of all
their words; the earliest copy is the reference.

Matches. A block whose words were indexed before points to its reference: first
among the blocks of one task (so a passage that a third of all documents share is
one row a task), then by anchor among all.

Boundaries. Blocks that share an anchor but differ somewhere are where matches
begin or end. There the single windows are looked up, each pointing to its
earliest copy, which makes the result that of comparing all windows. Anchors that
are so common that one task would hold too many rows skip the comparison by
anchor and are matched by window at once.

Parsing. In each document, matches that go on along one reference are joined.
From left to right, the longest one that covers the next word becomes a factor:
its words are a copy of the reference's. A match is a window long at least, so
every factor is part of a copy of ``length`` words or more. What factors cover is
removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm import common

#: Words in an anchor; rows that a task combines at a time; an anchor with more than one in HOT_SHARE of all blocks is hot for sure.
GRAM, CHUNK_ROWS, HOT_SHARE = 6, 2_000_000, 20_000
MATCHED, REFERENCE, HOT = 0, 1, 2
NO_ID = -(2**63)


def blocks(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one document: anchor, hash of all words, first window and number of windows of each block."""
    windows = len(h) - length + 1
    if windows <= 0:
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    k = min(GRAM, length)
    grams = common.gram_hashes(h, k)
    at = np.arange(windows) + np.lib.stride_tricks.sliding_window_view(grams, length - k + 1).argmin(1)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[first, windows])
    body = common.range_hashes(h, first, first + n + length - 1)
    return grams[at[first]], common.mix64(body ^ (at[first] - first).astype(np.uint64)), first, n


def earliest(keys: list[np.ndarray], doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by keys, document, row and position; whether nothing with the same keys comes before each there; and what does.

    Earlier are smaller documents, and smaller positions in the same row; rows of one document id aren't earlier than each other.
    """
    order = np.lexsort([pos, row, doc, *keys[::-1]])
    new = np.zeros(len(order), bool)
    if not len(order):
        return order, new, order
    new[0] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.arange(len(order))
    group = np.maximum.accumulate(np.where(new, at, 0))
    d, r, p = doc[order], row[order], pos[order]
    new[1:] |= (d[1:] != d[:-1]) | (r[1:] != r[:-1])
    same = np.maximum.accumulate(np.where(new, at, 0))
    in_first = d == d[group]
    return order, in_first & (p == p[same]), order[np.where(in_first, same, group)]


#: Of a match: its document and row, first window and number of windows, and where the reference starts.
MATCH = ("doc_id", "row", "pos", "n", "ref_doc", "ref_row", "ref_pos")


def merged(doc, row, pos, n, ref_doc, ref_row, ref_pos) -> tuple[np.ndarray, ...]:
    """Matches that touch and go on along one reference become one."""
    columns = [doc, row, pos, n, ref_doc, ref_row, ref_pos]
    if not len(doc):
        return tuple(columns)
    order = np.lexsort([pos, pos - ref_pos, ref_row, ref_doc, row, doc])
    doc, row, pos, n, ref_doc, ref_row, ref_pos = (c[order] for c in columns)
    other = np.zeros(len(doc), bool)  # another document, reference or distance between them
    for c in (doc, row, ref_doc, ref_row, pos - ref_pos):
        other[1:] |= c[1:] != c[:-1]
    line = other.cumsum() << 40
    end = np.maximum.accumulate(line + pos + n) - line  # the furthest end on this line so far
    at = np.flatnonzero(np.r_[True, other[1:] | (pos[1:] > end[:-1])])
    last = np.r_[at[1:], len(doc)] - 1
    return doc[at], row[at], pos[at], end[last] - pos[at], ref_doc[at], ref_row[at], ref_pos[at]


def factors(pos, n, ref_doc, ref_row, ref_pos, length: int) -> list[tuple[int, int, int, int]]:
    """The greedy parse of one document: start, words, and the reference's document and start of each factor."""
    zero = np.zeros(len(pos), np.int64)
    _, _, start, n, of, _, at = merged(zero, zero, *(np.asarray(c, np.int64) for c in (pos, n, ref_doc, ref_row, ref_pos)))
    end = start + n + length - 1
    order = np.lexsort([at, of, -end, start])
    rows = list(zip(*(c[order].tolist() for c in (start, end, of, at)), strict=True))
    found, p, i, best = [], 0, 0, None  # best: of the matches that start at p or before, the one that ends last
    while i < len(rows) or (best and best[1] > p):
        if not (best and best[1] > p):
            p = max(p, rows[i][0])
        while i < len(rows) and rows[i][0] <= p:
            if best is None or rows[i][1] > best[1]:
                best = rows[i]
            i += 1
        if best and best[1] > p:
            found.append((p, best[1] - p, best[2], best[3] + p - best[0]))
            p = best[1]
    return found


def parse(docs: DataFrame, length: int) -> DataFrame:
    """Matches among a task's own blocks, its references, and the anchors that may be hot (n: their rows)."""

    def combined(parts: list[tuple]) -> pa.RecordBatch:
        a, b, doc, row, pos, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first, before = earliest([a, b], doc, row, pos)
        match, ref, of = order[~first], order[first], before[~first]
        m = merged(doc[match], row[match], pos[match], n[match], doc[of], row[of], pos[of])
        anchors, counts = np.unique(a[ref], return_counts=True)
        hot = counts >= max(4, len(ref) // (4 * HOT_SHARE))
        anchors, counts = anchors[hot], counts[hot]
        zero = lambda k: np.zeros(k, np.int64)
        x, y, z = len(m[0]), len(ref), len(anchors)
        columns = [
            np.r_[np.full(x, MATCHED), np.full(y, REFERENCE), np.full(z, HOT)].astype(np.int8),
            np.r_[zero(x), a[ref].view(np.int64), anchors.view(np.int64)],
            np.r_[zero(x), b[ref].view(np.int64), zero(z)],
            np.r_[m[0], doc[ref], zero(z)],
            np.r_[m[1], row[ref], zero(z)],
            np.r_[m[2], pos[ref], zero(z)].astype(np.int32),
            np.r_[m[3], n[ref], counts].astype(np.int32),
            np.r_[m[4], zero(y + z)],
            np.r_[m[5], zero(y + z)],
            np.r_[m[6], zero(y + z)].astype(np.int32),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "a", "b", *MATCH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for doc, row, text in zip(*map(common.each, batch.columns), strict=True):
                a, b, pos, n = blocks(common.word_hashes(text.encode("utf-8", "surrogatepass").split()), length)
                if len(a):
                    parts.append((a, b, np.full(len(a), doc, np.int64), np.full(len(a), row, np.int64), pos, n))
                    rows += len(a)
                if rows >= CHUNK_ROWS:
                    yield combined(parts)
                    parts, rows = [], 0
        if parts:
            yield combined(parts)

    return docs.mapInArrow(run, "kind tinyint, a bigint, b bigint, doc_id bigint, row bigint, pos int, n int, ref_doc bigint, ref_row bigint, ref_pos int")


def match_windows(wanted: DataFrame, length: int) -> DataFrame:
    """Matches of single windows that start earlier elsewhere, from ``doc_id, row, runs, packed``."""

    def combined(parts: list[tuple]) -> pa.RecordBatch:
        a, w, doc, row, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first, before = earliest([a, w], doc, row, pos)
        match, ref, of = order[~first], order[first], before[~first]
        m = merged(doc[match], row[match], pos[match], np.ones(len(match), np.int64), doc[of], row[of], pos[of])
        x, y = len(m[0]), len(ref)
        zero, one = np.zeros(y, np.int64), np.ones(y, np.int64)
        columns = [
            np.r_[np.full(x, MATCHED), np.full(y, REFERENCE)].astype(np.int8),
            np.r_[np.zeros(x, np.int64), a[ref].view(np.int64)],
            np.r_[np.zeros(x, np.int64), w[ref].view(np.int64)],
            *(np.r_[c, d] for c, d in zip(m, (doc[ref], row[ref], pos[ref], one, zero, zero, zero), strict=True)),
        ]
        kinds = [pa.int8(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "a", "w", *MATCH])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            for doc, row, runs, packed in zip(*map(common.each, batch.columns), strict=True):
                h = common.word_hashes(unpack(packed).split())
                pos = np.unique(np.concatenate([np.arange(r["pos"], r["pos"] + r["n"]) for r in runs]))
                pos = pos[pos + length <= len(h)]
                w = common.range_hashes(h, pos, pos + length)
                again = common.range_hashes(common.mix64(h ^ np.uint64(0x9E3779B97F4A7C15)), pos, pos + length)  # 128 bits with the first
                parts.append((again, w, np.full(len(pos), doc, np.int64), np.full(len(pos), row, np.int64), pos))
                rows += len(pos)
                if rows >= CHUNK_ROWS:
                    yield combined(parts)
                    parts, rows = [], 0
        if parts:
            yield combined(parts)

    found = common.staged(wanted.mapInArrow(run, "kind tinyint, a bigint, w bigint, doc_id bigint, row bigint, pos int, n int, ref_doc bigint, ref_row bigint, ref_pos int"), "windows")
    order = Window.partitionBy("a", "w").orderBy("doc_id")  # a task names a row's earliest window only
    own = found.filter(F.col("kind") == REFERENCE).select("a", "w", "doc_id", "row", "pos", "n")
    later = own.withColumns({"r": F.rank().over(order), **references(order)}).filter("r > 1")
    return found.filter(F.col("kind") == MATCHED).select(*MATCH).unionByName(later.select(*MATCH))


def references(order: Window) -> dict:
    """The first row of the window as the reference."""
    return {f"ref_{out}": F.first(c).over(order) for c, out in (("doc_id", "doc"), ("row", "row"), ("pos", "pos"))}


def pack(docs: DataFrame) -> DataFrame:
    """``doc_id, row, packed``: texts in UTF-8 under Zstandard, for a smaller shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [z.compress(t.encode("utf-8", "surrogatepass")) for t in common.each(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "row", "packed"])

    return docs.mapInArrow(run, "doc_id bigint, row bigint, packed binary")


def unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def substring_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 20) -> DataFrame:
    """One row a document: ``doc_id, n_words, n_removed, kept_text, factors``.

    ``kept_text`` joins the words that stay by one space; ``factors`` (``start``,
    ``words``, ``ref_id``, ``ref_start``) are the copies, by words from 0. Null and empty texts
    have no words; texts shorter than a window lose none. Ids are whole numbers.
    Rows that repeat an id are told apart by their texts and aren't earlier than
    each other; rows without an id come before all others and aren't earlier than
    each other either. An empty table gives no rows; other columns are not read.
    """
    docs = common.documents(df, id_col, text_col).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    # Where every id is one row's, it names the row; else the text's hash does, too.
    unique = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    docs = docs.select("doc_id", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("row"), "text")
    parsed = common.staged(parse(docs, length), "blocks")
    refs = parsed.filter(F.col("kind") == REFERENCE)
    least = max(10_000, refs.count() // (2 * HOT_SHARE))  # so 2 * HOT_SHARE anchors at most
    hot = F.broadcast(parsed.filter(F.col("kind") == HOT).groupBy("a").agg(F.sum("n").alias("rows")).filter(F.col("rows") >= least).select("a"))

    by_block, by_anchor = Window.partitionBy("a", "b").orderBy("doc_id"), Window.partitionBy("a")
    blocks_ = refs.select("a", "b", "doc_id", "row", "pos", "n")
    ranked = blocks_.join(hot, "a", "left_anti").repartition("a").withColumns({"r": F.rank().over(by_block), **references(by_block)})
    # A block of several rows of one id counts more than once: that only means more windows to compare.
    ranked = ranked.withColumn("others", F.sum((F.col("r") == 1).cast("int")).over(by_anchor))
    decided = common.staged(ranked.filter("r > 1 OR others > 1").select(*MATCH, (F.col("r") == 1).alias("boundary")), "decided")

    own = ["doc_id", "row", "pos", "n"]
    boundary = decided.filter("boundary").select(*own).unionByName(blocks_.join(hot, "a", "left_semi").select(*own))
    runs = boundary.groupBy("doc_id", "row").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))
    texts = pack(docs)
    once = runs.join(texts, ["doc_id", "row"]).select("doc_id", "row", "runs", "packed")
    windows = match_windows(once, length)

    matches = parsed.filter(F.col("kind") == MATCHED).select(*MATCH).unionByName(decided.filter("NOT boundary").select(*MATCH)).unionByName(windows)
    lists = matches.groupBy("doc_id", "row").agg(F.collect_list(F.struct(*MATCH[2:])).alias("m"))
    joined = texts.join(lists, ["doc_id", "row"], "left").select("doc_id", "packed", *(F.col(f"m.{c}").alias(c) for c in MATCH[2:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, kept, found, sizes = [], [], [], [], [0]
            for packed, *match in zip(*map(common.each, batch.columns[1:]), strict=True):
                words = unpack(packed).split()
                total.append(len(words))
                copies = factors(*match, length) if match[0] else []
                if copies:
                    parts, after = [], 0
                    for start, n, *_ in copies:
                        parts += words[after:start]
                        after = start + n
                    words = parts + words[after:]
                found += copies
                sizes.append(len(found))
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            start, n, of, at = np.array(found, np.int64).reshape(-1, 4).T
            fields = [pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(of, pa.int64(), mask=of == NO_ID), pa.array(at, pa.int32())]
            copies = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "words", "ref_id", "ref_start"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), copies], ["doc_id", "n_words", "n_removed", "kept_text", "factors"])

    done = joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, factors array<struct<start:int,words:int,ref_id:bigint,ref_start:int>>")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)),
repeats AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS p FROM repeats, range(20) r(j)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
