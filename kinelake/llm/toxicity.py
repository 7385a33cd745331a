"""Toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and their first three to six letters,
hashed into ``BUCKETS``. A text's score is a logistic function of a bias, the
weights of its terms, and for each pair of terms the product of two learned
vectors: a pair (an insult next to a mention of a group) can count for more
than its parts do.

Training is bounded: at most about ``per_class`` labelled documents of each
class (chosen by a hash of the id, weighted back to the true shares) send their
hashed terms to the driver, equal texts once. Every term of two documents or
more carries a weight and a vector. Terms that tell the classes apart by less
than ``SURE_Z`` deviations take smaller steps, but never less than ``SHORT``
such terms of full steps would take in a text together: else long texts would be
learned by heart. Scoring is a scan and a map, with the model (36 bytes a term,
``BUCKETS`` terms at most) broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import common

#: Letters of the beginnings of words that are terms.
PREFIXES = (3, 4, 5, 6)
BUCKETS, FACTORS, SURE_Z, SHORT, DECAY, EPOCHS = 1 << 20, 8, 7.0, 2, np.float32(1e-3), 15
_WORDS = re.compile(r"\w+").findall


def buckets(word: str) -> list[int]:
    """The buckets of a word and of its beginnings, which differ from words as terms."""
    from xxhash import xxh3_64_intdigest

    terms = [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]
    return [xxh3_64_intdigest(t) % BUCKETS for t in terms]


class Machine:
    """The model: for the buckets it knows, weights and vectors."""

    def __init__(self, known: np.ndarray, bias: float, weight: np.ndarray, vectors: np.ndarray):
        self.at = np.full(BUCKETS, -1, np.int32)
        self.at[known] = np.arange(len(known))
        self.bias, self.weight, self.vectors = bias, weight, vectors
        self.cache: dict[str, tuple[int, ...]] = {}

    def __reduce__(self):
        return Machine, (np.flatnonzero(self.at >= 0), self.bias, self.weight, self.vectors)

    def score(self, text: str) -> float:
        if len(self.cache) > 500_000:
            self.cache.clear()
        found: set[int] = set()
        cache, at = self.cache, self.at
        for word in set(_WORDS(text.lower())):
            terms = cache.get(word)
            if terms is None:
                cache[word] = terms = tuple(i for i in at[buckets(word)].tolist() if i >= 0)
            if terms:
                found.update(terms)
        terms = np.fromiter(found, np.int64, len(found))
        v = self.vectors[terms]
        y = self.bias + self.weight[terms].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def fit(terms: list[np.ndarray], toxic: np.ndarray, share: np.ndarray, seed: int = 3) -> Machine:
    """A factorization machine from each document's buckets; ``share``: how many documents each stands for."""
    share = share / share.mean() if len(share) else share  # their ratio counts, not the size of the input
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    found = np.bincount(np.concatenate([*terms, np.empty(0, np.int64)]).astype(np.int64), minlength=BUCKETS)
    known = np.flatnonzero(found >= 2)
    at = np.full(BUCKETS, -1)
    at[known] = np.arange(len(known))
    own = [x[x >= 0] for x in (at[t.astype(np.int64)] for t in terms)]
    flat = np.concatenate([*own, np.empty(0, np.int64)]).astype(np.int64)
    row = np.repeat(np.arange(len(own)), [len(t) for t in own])
    c1 = np.bincount(flat[toxic[row] == 1], minlength=len(known)) + 0.5
    c0 = np.bincount(flat[toxic[row] == 0], minlength=len(known)) + 0.5
    z = (np.log(c1 / (n1 + 1)) - np.log(c0 / (n0 + 1))) / np.sqrt(1 / c1 + 1 / c0)
    sure = np.minimum(1, (z / SURE_Z) ** 2).astype(np.float32)

    rng = np.random.default_rng(seed)
    w, v, bias = np.zeros(len(known), np.float32), rng.normal(0, 0.01, (len(known), FACTORS)).astype(np.float32), np.log(share[toxic == 1].sum() + 1) - np.log(share[toxic == 0].sum() + 1)
    gw, gv, gb = np.full(len(known), 1e-6, np.float32), np.full((len(known), FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):  # AdaGrad, a document at a time
        for i in rng.permutation(len(own)):
            t = own[i]
            wt, vt = w[t], v[t]
            s = vt.sum(0)
            y = bias + wt.sum() + 0.5 * ((s**2).sum() - (vt**2).sum())
            g = np.float32((1 / (1 + np.exp(-np.clip(y, -30, 30))) - toxic[i]) * share[i])
            gb += g * g
            bias -= 0.1 * g / gb**0.5
            if len(t):
                step = np.maximum(sure[t], np.float32(min(1, SHORT / len(t))))
                dw, dv = g + DECAY * wt, g * (s - vt) + DECAY * vt
                gw[t] += dw**2
                gv[t] += dv**2
                w[t] = wt - np.float32(0.1) * step * dw / np.sqrt(gw[t])
                v[t] = vt - np.float32(0.02) * step[:, None] * dv / np.sqrt(gv[t])
    return Machine(known, float(bias), w, v)


def train(docs: DataFrame, labels: DataFrame, per_class: int) -> Machine:
    """``docs``: doc_id, text. ``labels``: doc_id, toxic (0 or 1), only rows to learn from."""
    counts = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    keep = {y: min(1.0, per_class / max(1, n)) for y, n in counts.items()}
    some = F.lit(False)
    for y, n in counts.items():
        some = some | ((F.col("toxic") == y) & common.drawn("doc_id", per_class, n))
    # About per_class rows of each class, so it can be broadcast.
    chosen = F.broadcast(labels.filter(some).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({b for w in set(_WORDS(t.lower())) for b in buckets(w)}) for t in common.each(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(terms, pa.list_(pa.int32()))], ["toxic", "terms"])

    table = docs.join(chosen, "doc_id").select("text", "toxic").mapInArrow(run, "toxic int, terms array<int>").toArrow()
    rows = {(y, t.as_py() is not None and bytes(t.values.to_numpy())): t.values.to_numpy() for y, t in zip(table.column(0).to_pylist(), table.column(1), strict=True)}
    rows = dict(sorted(rows.items()))
    toxic = np.array([y for y, _ in rows], np.int64)
    share = np.array([1 / keep[y] for y in toxic.tolist()])
    return fit(list(rows.values()), toxic, share)


def toxicity(df: DataFrame, labels: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", per_class: int = 3000) -> DataFrame:
    """One row a document: ``doc_id, held_out, score, predicted``.

    ``labels``: ``doc_id``, ``toxic`` (null: not learned from); ``held_out``: a
    condition on ``doc_id`` for rows whose labels aren't learned from. An empty
    or null text scores as the bias says; with no labels at all every score is
    a half. Repeated rows give repeated rows, an empty table none; other columns
    are not read.
    """
    docs = common.documents(df, id_col, text_col)
    known = labels.select(labels["doc_id"], labels["toxic"]).filter(~held_out & F.col("toxic").isNotNull())
    model = df.sparkSession.sparkContext.broadcast(train(docs, known, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(score, common.each(batch.column(2))), pa.float64())], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an id a document isn't held out; it has no label either."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return toxicity(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"), fold)
