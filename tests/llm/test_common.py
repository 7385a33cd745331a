"""What the text operators share."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinelake.llm import common
from kinelake.llm.components import components


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2)), max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_runs_of_keys_over_any_batches(keys, cuts):
    rows = [(a, b, i) for i, (a, b) in enumerate(sorted(keys))]
    edges = sorted({0, len(rows), *(c for c in cuts if c <= len(rows))})
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.int64()) for k in range(3)], ["a", "b", "i"])
    got = [[tuple(r.values()) for r in t.to_pylist()] for t in common.runs_of_keys((batch(rows[i:j]) for i, j in zip(edges, edges[1:], strict=False)), 2)]
    want = [[r for r in rows if r[:2] == k] for k in sorted(set(keys))]
    assert got == want


def test_values_come_one_by_one():
    column = pa.array([None, *map(str, range(700))])
    assert list(common.each(column)) == column.to_pylist() and list(common.each(column.slice(0, 0))) == []


def test_small_and_large_sides_give_the_same(spark):
    docs = spark.range(50).select((F.col("id") % 20).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("v"))
    few = common.staged(spark.createDataFrame([(3,), (5,), (99,)], "k bigint"), "few")
    for most in (0, 10):
        assert sorted(r["k"] for r in common.only(docs, few, "k", most).collect()) == [3, 3, 3, 5, 5, 5]
        left = common.without(docs, few, docs["k"] == few["k"], most)
        assert left.columns == docs.columns and left.count() == 44


def test_hot_rows_join_as_others_do(spark):
    left = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).otherwise(1).alias("k"), "id")
    right = spark.createDataFrame([(1, 100, True), (2, 7, False), (4, 8, False), (9, 1, True)], "k bigint, n int, hot boolean")
    for how in ("inner", "left"):
        got = sorted(common.join_hot(left, right, ["k"], F.col("hot"), how).select("k", "id", "n").collect(), key=str)
        assert got == sorted(left.join(right, "k", how).select("k", "id", "n").collect(), key=str)


def test_components_of_stars_chains_and_hubs(spark):
    """A hub with many edges, a long chain, and cycles; labels are the smallest ids."""
    edges = [(0, i) for i in range(100, 2700)] + [(i, i + 1) for i in range(5000, 5060)] + [(9000, 9001), (9001, 9002), (9002, 9000)] + [(2600, 5060), (7, 7)]
    up = {v: v for e in edges for v in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r["v"]: r["label"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: root(v) for v in up if v != 7}
