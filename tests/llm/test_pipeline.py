"""The pipeline against the same stages by brute force."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinelake.llm import common
from tests.llm.test_llm import near_groups, sentence

corpus_pipeline = pytest.importorskip("corpus_pipeline")

BENCH = sentence(30, 777)


@pytest.fixture(scope="module")
def sf(spark):
    d = common.new_path(spark, "sf")
    rows = [(i, sentence(40 + i % 9, i), "en" if i % 2 else "de", f"s{i % 3}") for i in range(90)]
    rows += [(90, rows[3][1], "en", "s0"), (91, rows[4][1] + " more", "de", "s1"), (92, f"{sentence(20, 900)} {BENCH} {sentence(20, 901)}", "en", "s2"), (93, "123 --", "en", "s0"), (94, None, "en", "s0"), (95, "", None, None), (96, sentence(50, 950), None, None)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, BENCH), (2, sentence(30, 778))], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def test_stages(spark, sf):
    d, rows = sf
    docs = common.read(spark, d, "documents")
    columns, kept = docs.columns, {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.staged(stage(spark, docs, d), "stage")
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            kept = {i: t for i, t in kept.items() if i not in (93, 94, 95)}
        elif k == 1:
            last = {}
            for i, t in kept.items():
                last[t] = max(last.get(t, i), i)
            kept = {i: t for t, i in last.items()}
        elif k == 2:
            groups = near_groups(list(kept.items()), corpus_pipeline.PERCENT)
            kept = {i: t for i, t in kept.items() if groups[i][2]}
        elif k == 3:
            kept = {i: t for i, t in kept.items() if BENCH not in t}
        else:
            assert set(got.items()) <= set(kept.items())
            assert docs.columns == [*columns, "copies"] and docs.filter("copies < 1").count() == 0
            taken = sum(r["copies"] * len(r["text"].split()) for r in docs.collect())
            total = 1.5 * sum(len(t.split()) for t in kept.values())
            assert abs(taken - total) <= 4 * 50
            continue
        assert got == kept, name


def test_run(spark, sf):
    first, again = (sorted((r["doc_id"], hashlib.md5(r["text"].encode()).hexdigest(), r["copies"]) for r in corpus_pipeline.run(spark, sf[0]).collect()) for _ in range(2))
    assert first == again and first


def test_null_and_repeated_ids(spark, sf):
    """Decisions hit the row they are about: rows without an id too, and not another row of the same id."""
    near = [sentence(80, 5), sentence(80, 5) + " more", sentence(80, 6), sentence(80, 7), sentence(80, 7) + " end", sentence(80, 8)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip([-1, 4, 4, None, None, None], near, strict=True)], schema)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs, sf[0]).collect()]
    assert {(-1, near[0]), (4, near[2]), (None, near[5])} <= set(got) and len(got) == 4 and (4, near[1]) not in got

    dirty = f"{sentence(20, 900)} {BENCH}"
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(None, dirty), (1, dirty), (1, near[2]), (None, near[5])]], schema)
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate(spark, docs, sf[0]).collect()}
    assert got == {(1, near[2]), (None, near[5])}


def test_columns_of_any_name_pass_through(spark, sf):
    """Names that stages use themselves, very long texts, and rows that repeat."""
    extra = "lang_pred string, main_lang int, key string, gone int, n_chars bigint, kept string, component_id int"
    long = sentence(20_000, 12)
    rows = [(i, t, "en", "s", "mine", 1, "k", 2, 3, "x", 4) for i, t in [(1, long), (1, long), (2, sentence(60, 1)), (None, sentence(60, 2)), (None, None)]]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, {extra}")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, sf[0])
        got = Counter(tuple(r)[:11] for r in found.collect())
        assert set(got) <= set(rows) and found.columns[:11] == docs.columns
        if k < 4:
            assert got == Counter(rows if k else rows[:4])


def test_empty(spark):
    d = common.new_path(spark, "sf")
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).agg(F.count("*")).first()[0] == 0
