"""Languages of a document by multilingual mixture inference.

A document is a mixture: each of its character trigrams comes from one of the
learned languages, in proportions that expectation-maximisation estimates from
the trigrams' likelihoods. Which languages take part is chosen by penalised
likelihood: the set grows, the likeliest first, while each language more gains
more than half the logarithm of the number of trigrams. The prediction is the
language with the largest share, and the score is that share.

Learning is bounded: about ``per_language`` documents of each language (by a
hash of the id) are counted, on the executors; a few thousand buckets for each
language reach the driver. Inference is a scan and a map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import common

BUCKETS, STEPS = 1 << 14, 25
_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter, and how often each occurs; anything but letters is one gap."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[c]
    c = np.where(letter, c, np.uint32(32))
    keep = letter[1:-1]
    g = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D))[keep]
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x2C1B3C6D)
    return np.unique((g >> np.uint32(18)).astype(np.int64), return_counts=True)


def shares(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns of ``p``), and the log-likelihood."""
    pi = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(STEPS if len(pi) > 1 else 0):
        new = (p / (p @ pi)[:, None]).T @ n * pi / n.sum()
        if np.abs(new - pi).max() < 1e-4:
            pi = new
            break
        pi = new
    return pi, float(n @ np.log(p @ pi))


def infer(text: str, table: np.ndarray) -> tuple[int, float]:
    """The main language's number and share; -1 if there is no letter."""
    g, n = trigrams(text)
    if not len(g) or not table.shape[1]:
        return -1, 0.0
    p = table[g]
    order = np.argsort(-shares(p, n)[0], kind="stable")
    best, cost = None, 0.5 * np.log(max(2, n.sum()))
    for k in range(1, len(order) + 1):
        pi, fit = shares(p[:, order[:k]], n)
        if best and fit - cost * k <= best[0]:
            break
        best = fit - cost * k, int(order[pi.argmax()]), float(pi.max())
    return best[1], min(1.0, best[2])


def learn(known: DataFrame, per_language: int) -> tuple[list[str], np.ndarray]:
    """The languages, and each bucket's probability in each. ``known``: doc_id, text, lang."""
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    some = F.lit(False)
    for x in langs:
        some = some | ((F.col("lang") == x) & common.drawn("doc_id", per_language, counts[x]))
    at = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(at), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(*map(common.each, batch.columns), strict=True):
                g, n = trigrams(text)
                total[at[lang], g] += n
        x, y = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(total[x, y])], ["l", "g", "n"])

    summed = known.filter(some).select("lang", "text").mapInArrow(run, "l int, g int, n bigint").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(langs)), 0.5)
    table[summed.column("g").to_numpy(), summed.column("l").to_numpy()] += summed.column("n").to_numpy()
    return langs, table / table.sum(0)


def identify(df: DataFrame, known: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_language: int = 2000, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``df`` and two more: by ``names``, the language and its share, in place of columns of those names.

    ``known``: rows with ``doc_id``, ``text``, ``lang`` to learn from (null text
    or language: not used). ``und`` with score 0 stands for null texts, texts
    without a letter, and when nothing is learned. Repeated rows are judged
    alike; an empty table gives no rows.
    """
    common.prepare(df.sparkSession)
    langs, table = learn(known.select("doc_id", "text", "lang").dropna(subset=["text", "lang"]), per_language)
    model = df.sparkSession.sparkContext.broadcast((langs, table))

    @F.pandas_udf("struct<lang:string,score:double>")
    def judge(texts):
        import pandas as pd

        names, p = model.value
        found = [infer(t, p) if t else (-1, 0.0) for t in texts]
        return pd.DataFrame({"lang": [names[i] if i >= 0 else "und" for i, _ in found], "score": [s for _, s in found]})

    found = judge(F.coalesce(df[text_col].cast("string"), F.lit("")))
    own = [c for c in df.columns if c not in names]
    judged = df.select(F.struct(*own).alias("own"), found.alias("judged"))
    return judged.select("own.*", F.col("judged.lang").alias(names[0]), F.col("judged.score").alias(names[1]))


def held_out_fold(id_col: Column) -> Column:
    """Without an id a document is in no fold but that of learning."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), docs.filter(~held_out_fold(F.col("doc_id"))))
    return found.select("doc_id", held_out_fold(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
