"""Ranked lexical search over a clustered index, in an order found by recursive graph bisection.

Documents that share terms are brought together: recursive graph bisection
splits them in two halves of least cost (bits for the gaps between a term's
documents), by swapping the pairs that gain most, and goes on within each half.
Over the whole table this is done in two steps. A tree of ``LEAVES`` is fitted
to a sample of about ``SAMPLE`` documents, and every document follows it to the
leaf that suits it best; then each leaf, in blocks of about ``BLOCK`` documents,
is bisected in full down to clusters of ``CLUSTER``. The order is only a matter
of speed: every document is indexed, and results are exact.

The index has a row a cluster: its documents, and for each term the documents
that have it and the largest part that it adds to a score. From those follows
the most that any document of the cluster can score for an item. A search visits
clusters from the highest bound on, and stops where no bound reaches the worst of
the best ``k`` so far; where it just equals it, the smaller doc_id decides, so a
cluster is visited only if it has a smaller one. A first pass visits just enough
clusters for ``k`` scores, which gives each item a score to begin from anywhere.

The index holds the terms that the items ask for. Items come in blocks of about
``ITEM_BYTES``; vocabulary, tree and weights of one are broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm import common

CLUSTER, BLOCK, LEAVES, SAMPLE, ITEM_BYTES = 64, 2048, 64, 4096, 1 << 20
#: Rounds of swaps in a bisection at most.
ROUNDS = 10
#: What isn't part of a term becomes a space; the letters A to Z, and no others, become small.
_TERMS = bytes(c if c >= 128 or chr(c).isdigit() or "a" <= chr(c) <= "z" else c + 32 if "A" <= chr(c) <= "Z" else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def spread(ptr: np.ndarray) -> np.ndarray:
    """The row of each entry, of rows that start and end at ``ptr``."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def take(ptr: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of ``rows`` stand, and their own starts and ends."""
    sizes = ptr[rows + 1] - ptr[rows]
    own = np.r_[0, np.cumsum(sizes)]
    return np.arange(own[-1]) - np.repeat(own[:-1] - ptr[rows], sizes), own


def halves(ptr: np.ndarray, ids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Which of the rows go right: half of them, so that terms are spread as little as can be."""
    n = len(ptr) - 1
    right = np.arange(n) >= n // 2
    values, local = np.unique(ids, return_inverse=True)
    row, size = spread(ptr), len(values)
    sizes = np.array([n // 2, n - n // 2], float)
    bits = lambda d, k: d * np.log2(sizes[k] / (d + 1))
    for _ in range(rounds):
        of_right = right[row]
        d1 = np.bincount(local[of_right], minlength=size).astype(float)
        d0 = np.bincount(local[~of_right], minlength=size).astype(float)
        now = bits(d0, 0) + bits(d1, 1)
        to_right = now - bits(np.maximum(d0 - 1, 0), 0) - bits(d1 + 1, 1)
        to_left = now - bits(d0 + 1, 0) - bits(np.maximum(d1 - 1, 0), 1)
        gain = np.bincount(row, np.where(of_right, to_left[local], to_right[local]), minlength=n)
        left_rows, right_rows = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = left_rows[np.argsort(-gain[left_rows], kind="stable")], right_rows[np.argsort(-gain[right_rows], kind="stable")]
        k = min(len(a), len(b))
        swaps = int((gain[a[:k]] + gain[b[:k]] > 1e-9).sum())
        if not swaps:
            break
        right[a[:swaps]], right[b[:swaps]] = True, False
    return right


def bisected(ptr: np.ndarray, ids: np.ndarray, least: int) -> list[np.ndarray]:
    """The rows in an order found by recursive graph bisection, in clusters of ``least`` at most."""
    done, open_ = [], [np.arange(len(ptr) - 1)]
    while open_:
        rows = open_.pop()
        if len(rows) <= least:
            done.append(rows)
            continue
        at, own = take(ptr, rows)
        right = halves(own, ids[at])
        open_ += [rows[right], rows[~right]]  # the left half is next
    return done


def fit_tree(ptr: np.ndarray, ids: np.ndarray, vocabulary: int, leaves: int) -> np.ndarray:
    """Weights ``[node, term]``: a document goes right at a node if those of its terms add up to more than 0.

    Nodes are numbered from 1, those below ``i`` are ``2 * i`` and ``2 * i + 1``.
    A weight is the cost that a document with the term saves on the right.
    """
    weights, parts = np.zeros((leaves, vocabulary), np.float32), {1: np.arange(len(ptr) - 1)}
    for node in range(1, leaves):
        rows = parts.pop(node)
        if len(rows) > 1:
            at, own = take(ptr, rows)
            right = halves(own, ids[at])
            counts = [np.bincount(ids[at][right[spread(own)] == side], minlength=vocabulary) for side in (False, True)]
            sizes = (~right).sum(), right.sum()
            weights[node] = np.log2((counts[1] + 1) / sizes[1]) - np.log2((counts[0] + 1) / sizes[0])
            weights[node][counts[0] + counts[1] == 0] = 0
        else:
            right = np.zeros(len(rows), bool)
        parts[2 * node], parts[2 * node + 1] = rows[~right], rows[right]
    return weights


def route(weights: np.ndarray, ptr: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node, row, leaves = np.ones(len(ptr) - 1, np.int64), spread(ptr), len(weights)
    for _ in range(leaves.bit_length() - 1):
        node = 2 * node + (np.bincount(row, weights[node[row], ids], minlength=len(node)) > 0)
    return node - leaves


def parts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    m = 50 + (50 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, and the values, of a column of lists without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(sizes)].astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def as_lists(ptr: np.ndarray, values, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(values, kind))


INDEX = "block int, cluster int, ids array<bigint>, terms array<int>, tops array<int>, ptr array<int>, at array<int>, parts array<int>"


def build_block(block: pa.Table, docs: int, total: int, size: int) -> pa.Table:
    """The index rows of a block of documents ``block, doc_id, n, terms, tfs``."""
    block = block.combine_chunks()
    ptr, ids = lists(block.column("terms"))
    _, tf = lists(block.column("tfs"))
    n, doc_ids = block.column("n").to_numpy(), block.column("doc_id")
    part = parts(tf.astype(np.int64), n[spread(ptr)], docs, total)
    rows = {name: [] for name in ("ids", "terms", "tops", "ptr", "at", "parts")}
    clusters = bisected(ptr, ids, size)
    for members in clusters:
        at, own = take(ptr, members)
        order = np.argsort(ids[at], kind="stable")
        own_terms, first = np.unique(ids[at][order], return_index=True)
        own_parts = part[at][order]
        rows["ids"].append(doc_ids.take(pa.array(members)).to_pylist())
        rows["terms"].append(own_terms)
        rows["tops"].append(np.maximum.reduceat(own_parts, first))
        rows["ptr"].append(np.r_[first, len(order)])
        rows["at"].append(spread(own)[order])
        rows["parts"].append(own_parts)
    columns = [pa.array(np.full(len(clusters), block.column("block")[0].as_py()), pa.int32()), pa.array(range(len(clusters)), pa.int32())]
    columns += [pa.array(v, pa.list_(pa.int64() if k == "ids" else pa.int32())) for k, v in rows.items()]
    return pa.Table.from_arrays(columns, ["block", "cluster", *rows])


class Items:
    """A block of items: their ids, and for each the numbers and weights of its terms."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.vocabulary, self.terms = [r[0] for r in rows], {}, []
        for _, text in rows:
            own = {self.vocabulary.setdefault(t, len(self.vocabulary)) for t in terms(text or "")}
            self.terms.append(np.array(sorted(own), np.int64))

    def weigh(self, docs: int, holding: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(self.vocabulary))], np.int64)
        item, term = np.repeat(np.arange(len(self.terms)), [len(x) for x in self.terms]), np.concatenate([*self.terms, np.empty(0, np.int64)])
        order = np.argsort(term, kind="stable")
        self.asking = item[order]  # the items that ask for a term stand together
        self.starts = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))


class Best:
    """The ``k`` best (score, doc_id) so far: highest score, then smallest id, null last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor, self.visited = k, floor, 0
        self.score, self.id, self.none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def full(self) -> bool:
        return len(self.score) >= self.k

    def wants(self, bound: int, low: int) -> bool:
        """Whether a cluster of this bound and smallest id may change anything."""
        if bound <= 0 or bound < self.floor:
            return False
        return not self.full() or bound > self.score[-1] or (bound == self.score[-1] and (self.none[-1] or low < self.id[-1]))

    def done(self, bound: int) -> bool:
        """Whether no cluster of this bound or a smaller one can."""
        return bound <= 0 or bound < self.floor or (self.full() and bound < self.score[-1])

    def add(self, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        keep = (score > 0) & (score >= self.floor)
        score, ids, none = np.r_[self.score, score[keep]], np.r_[self.id, ids[keep]], np.r_[self.none, none[keep]]
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.id, self.none = score[order], ids[order], none[order]


def bounds(items: Items, ptr: np.ndarray, of_term: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """``[item, cluster]``: the most that a document of the cluster can score."""
    at, own = take(items.starts, of_term)
    entry = spread(own)
    clusters = len(ptr) - 1
    out = np.zeros(len(items.terms) * clusters, np.int64)
    np.add.at(out, items.asking[at] * clusters + spread(ptr)[entry], (items.weight[of_term] * tops)[entry])
    return out.reshape(len(items.terms), clusters)


def visit(items: Items, batch: pa.RecordBatch, best: list[Best], enough: bool = False) -> None:
    """Ranks the documents of some clusters; ``enough``: an item stops at its first ``k``."""
    column = {name: lists(batch.column(name)) for name in ("terms", "tops", "ptr", "at", "parts")}
    tptr, of_term = column["terms"]
    of_term = of_term.astype(np.int64)
    bound = bounds(items, tptr, of_term, column["tops"][1].astype(np.int64))
    ids = batch.column("ids")
    iptr = np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]
    flat = ids.flatten()
    none = flat.is_null().to_numpy(zero_copy_only=False)
    doc = flat.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    low = np.minimum.reduceat(doc, iptr[:-1])
    pptr, starts = column["ptr"]
    aptr, at = column["at"]
    part = column["parts"][1].astype(np.int64)
    for q, own in enumerate(items.terms):
        for c in np.argsort(-bound[q], kind="stable").tolist():
            if best[q].done(bound[q, c]) or (enough and best[q].full()):
                break
            if not best[q].wants(bound[q, c], low[c]):
                continue
            best[q].visited += 1
            known = of_term[tptr[c] : tptr[c + 1]]
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            score = np.zeros(iptr[c + 1] - iptr[c], np.int64)
            own_starts = starts[pptr[c] : pptr[c + 1]] + aptr[c]
            for t, p in zip(own.tolist(), place.tolist(), strict=True):
                if known[p] == t:
                    i, j = own_starts[p], own_starts[p + 1]
                    score[at[i:j]] += items.weight[t] * part[i:j]  # a document has a term once
            best[q].add(score, doc[iptr[c] : iptr[c + 1]], none[iptr[c] : iptr[c + 1]])


class Index:
    """The clustered index of ``docs`` (``doc_id, text``) for a block of items."""

    def __init__(self, docs: DataFrame, rows: list[tuple], *, cluster: int = CLUSTER, block: int = BLOCK, leaves: int = LEAVES, sample: int = SAMPLE):
        self.items = items = Items(rows)
        self.table, spark = None, docs.sparkSession
        vocabulary = spark.sparkContext.broadcast(items.vocabulary)  # of ITEM_BYTES

        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = vocabulary.value
            for batch in batches:
                n, sizes, ids, tfs = [], [], [], []
                for text in common.each(batch.column(1)):
                    found = Counter(terms(text))
                    own = [(known[t], tf) for t, tf in found.items() if t in known]
                    n.append(found.total())
                    sizes.append(len(own))
                    ids += [t for t, _ in own]
                    tfs += [tf for _, tf in own]
                ptr = np.r_[0, np.cumsum(sizes)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), as_lists(ptr, ids, pa.int32()), as_lists(ptr, tfs, pa.int32())], ["doc_id", "n", "terms", "tfs"])

        parsed = common.staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(parse, "doc_id bigint, n bigint, terms array<int>, tfs array<int>"), "parsed")
        self.docs, self.total = parsed.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = dict(parsed.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # terms of the block of items
        items.weigh(self.docs, holding)
        some = parsed.filter(F.size("terms") > 0).withColumn("row", F.xxhash64(F.monotonically_increasing_id()))  # the table is staged, so a row keeps its number
        n = some.count()
        if n:
            self.table = self.build(some, n, cluster, block, leaves, sample)

    def build(self, some: DataFrame, n: int, cluster: int, block: int, leaves: int, sample: int) -> DataFrame:
        drawn = some.filter(common.below("row", sample, n)).select("terms").collect()  # about ``sample`` rows
        ptr = np.r_[0, np.cumsum([len(r[0]) for r in drawn])].astype(np.int64)
        ids = np.concatenate([np.array(r[0], np.int64) for r in drawn] + [np.empty(0, np.int64)])
        tree = some.sparkSession.sparkContext.broadcast(fit_tree(ptr, ids, len(self.items.vocabulary), leaves))
        docs, total = self.docs, self.total

        def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = route(tree.value, *lists(batch.column(batch.schema.get_field_index("terms"))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "leaf"])

        routed = common.staged(some.mapInArrow(leaf, "doc_id bigint, n bigint, terms array<int>, tfs array<int>, row bigint, leaf int"), "routed")
        counts = dict(routed.groupBy("leaf").count().collect())  # a row a leaf
        blocks = [-(-counts.get(i, 0) // block) for i in range(leaves)]
        first = np.r_[0, np.cumsum(blocks)].tolist()
        own = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("leaf") + 1)
        dealt = routed.withColumn("block", (own(first[:-1]) + F.pmod("row", own(blocks))).cast("int"))
        rows = dealt.select("block", "doc_id", "n", "terms", "tfs").groupBy("block").applyInArrow(lambda t: build_block(t, docs, total, cluster), INDEX)
        return common.staged(rows, "index")

    def search(self, k: int) -> DataFrame:
        """``q, score, doc_id``: of the item in place ``q``, the best ``k`` and perhaps some more."""
        spark = self.table.sparkSession
        shared = spark.sparkContext.broadcast(self.items)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [Best(k, 0) for _ in shared.value.terms]
            for batch in batches:
                if batch.num_rows:
                    visit(shared.value, batch, best, enough=True)
            full = [q for q, b in enumerate(best) if b.full()]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([int(best[q].score[-1]) for q in full], pa.int64())], ["q", "floor"])

        floors = dict(self.table.mapInArrow(probe, "q int, floor bigint").groupBy("q").agg(F.max("floor")).collect())  # a row an item of the block

        def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [Best(k, floors.get(q, 0)) for q in range(len(shared.value.terms))]
            for batch in batches:
                if batch.num_rows:
                    visit(shared.value, batch, best)
            q = np.repeat(np.arange(len(best)), [len(b.score) for b in best])
            score, ids, none = (np.concatenate([getattr(b, x) for b in best]) for x in ("score", "id", "none"))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64(), mask=none)], ["q", "score", "doc_id"])

        return self.table.mapInArrow(rank, "q int, score bigint, doc_id bigint")


def ranked_search(df: DataFrame, queries: DataFrame, k: int = 50, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score above 0 for each item, equal scores by doc_id.

    Ids of documents are whole numbers; a null one comes after all others, and
    rows that repeat an id rank each for itself (of equal scores and ids, in any
    order, which doesn't show). Null and empty texts have no terms and are in no
    result; items without terms have none; items that repeat id and text count
    once, and texts that share an item's id rank each for itself; an empty table
    on either side gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    docs = common.documents(df, id_col, text_col)
    items = queries.select(queries[item_col].alias("item_id"), queries[item_text_col].cast("string").alias("text")).distinct()
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = -(-size // ITEM_BYTES)
    kind = items.schema["item_id"].dataType.simpleString()

    def one(block: int) -> DataFrame | None:
        own = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()]  # about ITEM_BYTES
        index = Index(docs, own, **options)
        if index.table is None:
            return None
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(own)], f"q int, item_id {kind}")
        order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = index.search(k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        found = best.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        return found if blocks == 1 else common.staged(found, "ranked")  # done before the next block is loaded

    found = [x for x in map(one, range(blocks)) if x is not None]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
stats AS (SELECT count(*) AS docs, sum(len(t))::BIGINT AS total FROM low WHERE len(t) > 0),
tf AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM low),
posts AS (SELECT r, doc_id, n, term, count(*) AS tf FROM tf GROUP BY ALL),
holding AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT item_id, term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM asked JOIN holding USING (term), stats),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // total)))))::BIGINT AS score
  FROM weights JOIN posts USING (term), stats GROUP BY ALL),
ranks AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranks WHERE rank <= 50
"""
