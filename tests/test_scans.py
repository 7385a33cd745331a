"""Scans of parted groups, sweeps, selection and mergeable histograms against plain Python."""

import math
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinelake.operators import aggregates, filters, intervals, joins, quantiles, sampling, scans, windows


def rows(seed, n=200):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "a", None, "b", "c"]), r.randint(0, 60), r.choice([None, 1, 2, 3, 5]), i) for i in range(n)]


CARRIES = {"s": scans.total("v"), "h": scans.highest("v", True), "m": scans.lowest("v"), "l": scans.last("v"), "f": scans.first("v", True)}


def scanned(values):
    """What CARRIES give along a group, by plain Python."""
    fold = {"s": sum, "h": max, "m": min, "l": lambda x: x[-1], "f": lambda x: x[0]}
    for i in range(len(values)):
        before, after = [v for v in values[:i] if v is not None], [v for v in values[: i + 1] if v is not None]
        yield tuple(fold[k](x) if (x := after if CARRIES[k].after else before) else None for k in CARRIES)


@pytest.mark.parametrize("range_rows", [25, 1000])
def test_segmented_scan(spark, range_rows):
    """Groups of one range, of many, and several in one range; ties only in what is told apart by ``i``."""
    data = rows(1)
    df = spark.createDataFrame(data, "g string, t int, v int, i int").repartition(3)
    want = {}
    for g in {g for g, *_ in data}:
        own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1], x[3]))
        want |= {x[3]: found for x, found in zip(own, scanned([x[2] for x in own]), strict=True)}
    got = scans.segmented_scan(df, ["g"], ["t", "i"], CARRIES, range_rows).collect()
    assert {r["i"]: tuple(r[k] for k in CARRIES) for r in got} == want and len(got) == len(data)


@pytest.mark.parametrize("range_rows", [9, 1000])
def test_scan_without_groups_backwards_and_empty(spark, range_rows):
    data = rows(2)
    df = spark.createDataFrame(data, "g string, t int, v int, i int")
    own = sorted(data, key=lambda x: (-x[1], x[3]))
    want = {x[3]: found for x, found in zip(own, scanned([x[2] for x in own]), strict=True)}
    got = scans.segmented_scan(df, [], [F.desc("t"), "i"], CARRIES, range_rows).collect()
    assert {r["i"]: tuple(r[k] for k in CARRIES) for r in got} == want
    assert scans.segmented_scan(df.limit(0), ["g"], ["t"], CARRIES, range_rows).count() == 0


@pytest.mark.parametrize("range_rows", [5, 1000])
def test_parted_intervals_and_ranges(spark, range_rows):
    r = random.Random(3)
    spans = [(g, s, s + r.randint(0, 6)) for g, s in [(r.choice("xyyy"), r.randint(0, 300)) for _ in range(90)]]
    totals = [("x", 320), ("y", 320), ("z", 50), ("w", 0)]
    i, t = spark.createDataFrame(spans, "g string, start long, end long"), spark.createDataFrame(totals, "g string, total long")
    merged = intervals.merge(i, "g", range_rows)
    got = {g: sorted((s, e) for h, s, e in merged.collect() if h == g) for g in "xy"}
    for g, parts in got.items():
        covered = {x for h, s, e in spans if h == g for x in range(s, e)}
        assert {x for s, e in parts for x in range(s, e)} == covered
        assert all(a[1] < b[0] for a, b in zip(parts, parts[1:], strict=False))  # not even touching
    gaps = intervals.complement(merged, t, "g", range_rows).collect()
    for g, n in totals:
        own = [(s, e) for h, s, e in gaps if h == g]
        assert Counter(x for s, e in own for x in range(s, e)) == Counter(set(range(n)) - {x for h, s, e in spans if h == g for x in range(s, e)})
    frames = [(r.choice("xyzw"), r.randint(0, 320), k) for k in range(300)] + [(None, 3, -1), ("x", None, -2)]
    bad = [(None, 0, 400), ("z", None, 400), ("z", 0, None)]
    f, wide = spark.createDataFrame(frames, "g string, t int, k int"), i.unionByName(spark.createDataFrame(bad, "g string, start long, end long"))
    inside = filters.in_ranges(f, wide, key="g", range_rows=range_rows)
    assert sorted(x["k"] for x in inside.collect()) == sorted(k for g, t, k in frames if t is not None and any(h == g and s <= t < e for h, s, e in spans))
    assert inside.columns == f.columns


def test_one_key_with_many_frames_and_ranges(spark, monkeypatch):
    """10^5 frames and 10^4 overlapping ranges of one key: no pairs in the plan, and each range of the sweep is small."""
    monkeypatch.setattr(aggregates, "RANGE_ROWS", 20_000)
    f = spark.range(100_000).select(F.lit("k").alias("episode"), F.col("id").alias("t"))
    r = spark.range(10_000).select(F.lit("k").alias("episode"), (F.col("id") * 9).alias("start"), (F.col("id") * 9 + F.col("id") % 20).alias("end"))
    swept = filters.in_ranges(f, r)
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "LeftSemi" not in plan
    inside = np.zeros(100_000, bool)
    for i in range(10_000):
        inside[i * 9 : i * 9 + i % 20] = True
    assert swept.count() == inside.sum()


SPECIAL = [0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf, 1.0, 1.0000000000000002, 1.0]


def quantile(values, q):
    at = q * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


def test_selection_equals_sorting(spark):
    r = random.Random(4)
    data = [("wide", r.choice([-1, 1]) * 10 ** r.uniform(-300, 300)) for _ in range(700)] + [("tied", float(r.choice([1, 1, 1, 2, 7]))) for _ in range(500)]
    data += [("special", x) for x in SPECIAL * 20] + [(None, r.gauss(0, 1)) for _ in range(300)] + [("few", 3.5)] + [("none", None)] + [("close", 1 + i * 2.0**-52) for i in range(400)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    qs = {"a": 0.0, "b": 0.013, "c": 0.5, "d": 0.77, "e": 1.0}
    for few, digits in ((50, 64), (4096, 1024)):
        got = {x["g"]: x for x in quantiles.exact_quantiles(df, ["g"], "v", qs, few, digits).collect()}
        assert set(got) == {"wide", "tied", "special", None, "few", "close"}
        for g, found in got.items():
            values = sorted(v for h, v in data if h == g and v is not None)
            for name, q in qs.items():
                want = quantile(values, q)
                assert found[name] == want or math.isclose(found[name], want, rel_tol=1e-12) or (math.isnan(want) and math.isnan(found[name])), (g, name)
    assert quantiles.exact_quantiles(df.limit(0), ["g"], "v", qs).count() == 0


def test_nan_is_the_largest_value(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(60)] + [("a", math.nan)] * 40, "g string, v double")
    got = quantiles.exact_quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.9}, 8, 8).first()
    assert got["a"] == 24.75 and math.isnan(got["b"])


@pytest.fixture(scope="module")
def grid_of(spark):
    def grid(values, bins=64):
        df = spark.createDataFrame([("k", 0, float(v)) for v in values], "key string, dim long, value double")
        return quantiles.grid_histogram(df, bins=bins)

    return grid


def cells(grid):
    return sorted(tuple(r[c] for c in ("key", "dim", "e", "cell", "c", "low", "high")) for r in grid.collect())


@settings(max_examples=3, deadline=None)
@given(st.lists(st.lists(st.floats(-1e6, 1e6) | st.sampled_from([0.0, 1e-300, -3.25, 3.25]), min_size=1, max_size=30), min_size=2, max_size=3), st.randoms())
def test_parts_merge_in_any_order(grid_of, parts, rnd):
    whole = cells(grid_of([v for p in parts for v in p]))
    assert len(whole) <= 64
    grids = [grid_of(p) for p in parts]
    rnd.shuffle(grids)
    once = grids[0]
    for g in grids[1:]:
        once = quantiles.merged_grids(once.unionByName(g), bins=64)
    assert cells(once) == whole
    together = grids[0]
    for g in grids[1:]:
        together = together.unionByName(g)
    assert cells(quantiles.merged_grids(together, bins=64)) == whole


def test_grid_quantiles_are_within_a_cell(grid_of):
    values = np.random.default_rng(5).normal(3, 20, 3000)
    found = quantiles.grid_quantiles(grid_of(values, 5000), {"a": 0.01, "b": 0.5, "c": 0.99}).first()
    width = 2.0 ** math.ceil(math.log2((values.max() - values.min()) / 4999))
    for name, q in (("a", 0.01), ("b", 0.5), ("c", 0.99)):
        assert 0 <= np.sort(values)[math.ceil(q * 3000) - 1] - found[name] <= width


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=7), st.integers(1, 4))
def test_any_prefix_of_the_schedule_keeps_the_shares(parts, rounds):
    """For all prefixes, over the seams of rounds too, each dataset has its share within one."""
    total = sum(parts)
    from fractions import Fraction

    weights = {str(i): Fraction(p, total) for i, p in enumerate(parts)}
    turns = sampling.schedule(weights) * rounds
    count = Counter()
    for n, name in enumerate(turns, 1):
        count[name] += 1
        assert all(abs(count[k] - w * n) < 1 for k, w in weights.items())


def test_interleaved(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)] + [("b", i) for i in range(7)] + [("c", 0), ("unused", 0)], "dataset string, pos long")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0}
    got = sorted((r["place"], r["dataset"], r["pos"], r["epoch"]) for r in sampling.interleaved(df, weights, 333).collect())
    assert [g[0] for g in got] == list(range(333))
    seen = Counter()
    for n, (_, name, pos, epoch) in enumerate(got, 1):
        size = {"a": 50, "b": 7, "c": 1}[name]
        assert (epoch, pos) == divmod(seen[name], size)  # each in its own order, from the start again when used up
        seen[name] += 1
        assert all(abs(seen[k] - w * n) < 1 for k, w in weights.items())
    assert sampling.interleaved(df, weights, 0).count() == 0
    for bad in ({"a": 0.5}, {"a": 0.5, "gone": 0.5}, {"a": 0.5, "b": 0.49999999, "c": 0.00000001}):
        with pytest.raises(ValueError):
            sampling.interleaved(df, bad, 10)


def test_at_times(spark):
    """Irregular stamps, a gap of dropped frames, equal stamps, clamping at both ends."""
    stamps = {"a": [0.0, 0.1, 0.2, 0.5, 0.6, 0.6, 0.71], "b": [5.0]}
    data = [(e, i, ts, float(10 * i + (e == "b"))) for e, all_ in stamps.items() for i, ts in enumerate(all_)]
    df = spark.createDataFrame(data, "episode string, i int, ts double, value double")
    got = {(r["episode"], r["i"]): [(x["value"], x["pad"]) for x in r["values"]] for r in joins.at_times(df, [-0.1, 0.0, 0.1], "value", tolerance=0.02, tie="i").collect()}
    assert got["a", 0] == [(0.0, True), (0.0, False), (10.0, False)]
    assert got["a", 2] == [(10.0, False), (20.0, False), (None, False)]  # 0.3 was dropped
    assert got["a", 3] == [(None, False), (30.0, False), (40.0, False)]  # of equal stamps the least tie
    assert got["a", 5] == [(30.0, False), (40.0, False), (60.0, False)]  # 0.7 is 0.71 within the tolerance
    assert got["a", 6] == [(40.0, False), (60.0, False), (60.0, True)]
    assert got["b", 0] == [(1.0, True), (1.0, False), (1.0, True)]
    one = joins.at_times(df, [-0.1, 0.0, 0.1], "value", tolerance=0.02, tie="i")._jdf.queryExecution().executedPlan().toString()
    assert one.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("range_rows", [4, 1000])
def test_masks_as_prefixes(spark, monkeypatch, range_rows):
    monkeypatch.setattr(aggregates, "RANGE_ROWS", range_rows)
    r = random.Random(6)
    data = [(s, i, r.choice([0, 0, 1]), r.choice([True, True, True, False])) for s, n in (("a", 23), ("b", 1), ("c", 9)) for i in range(n)]
    df = spark.createDataFrame(data, "seq string, pos long, ar int, valid boolean")
    p = windows.causal_prefixes(df)
    assert p.count() == len(data)
    pairs = {tuple(x) for x in windows.causal_mask(df).filter("attends").select("seq", "i", "j").collect()}
    got = [tuple(x) for x in windows.expand_mask(p, windows.valid_runs(df)).collect()]
    assert set(got) == pairs and len(got) == len(pairs)


def test_buffered_keeps_rows_near(spark):
    places = spark.range(2000).withColumnRenamed("id", "place")
    order = [x["place"] for x in sampling.buffered(places, 50, 1).orderBy("at", "place").collect()]
    assert sorted(order) == list(range(2000)) and order != list(range(2000))
    assert max(abs(a - b) for a, b in enumerate(order)) < 50


def test_accumulate_is_the_running_total(spark):
    """The same scan numbers rows within a hot group."""
    df = spark.range(500).select(F.lit(1).alias("g"), "id", (F.col("id") % 7).alias("v"))
    got = {x["id"]: x["s"] for x in scans.segmented_scan(df, ["g"], ["id"], {"s": scans.total("v", True)}, 50).collect()}
    assert [got[i] for i in range(500)] == list(accumulate(i % 7 for i in range(500)))
