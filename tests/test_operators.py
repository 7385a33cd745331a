"""Literal cases."""

import glob
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinelake.functions import texts, vectors
from kinelake.operators import aggregates, filters, intervals, joins, project, sampling, windows
from kinelake.plans import pipelines
from kinelake.sources import readers, wire
from kinelake.streaming import sessions


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def frames(spark, actions):
    return spark.createDataFrame([("e", t, a) for t, a in enumerate(actions)], "episode string, t bigint, action double")


def moves(spark, *parts):
    """Frames that move or stay, as (count, moving) parts; staying means no change from the frame before."""
    rows, x = [], 0.0
    for n, moving in parts:
        for _ in range(n):
            x += moving
            rows.append(("e", len(rows), [x]))
    return spark.createDataFrame(rows, "episode string, t bigint, vector array<double>")


def record(spark):
    """Three levels, a null group and an array."""
    return spark.sql("""SELECT named_struct('joint', array(0.5D, 1.5D), 'grip', named_struct('open', 0.25D, 'raw', CAST(NULL AS DOUBLE))) AS arm,
        named_struct('front', 'f.png', 'wrist', 'w.png') AS cam, 17L AS stamp""")


def test_repack(spark):
    got = project.repack(record(spark), {"obs": {"grip": {"now": "arm/grip/open"}, "view": "cam/wrist"}, "q": "arm/joint", "raw": "arm/grip/raw"})
    assert got.first().asDict(True) == {"obs": {"grip": {"now": 0.25}, "view": "w.png"}, "q": [0.5, 1.5], "raw": None}
    with pytest.raises(KeyError, match="arm/wheel"):
        project.repack(record(spark), {"x": "arm/wheel"})
    with pytest.raises(KeyError):  # a group isn't a leaf
        project.repack(record(spark), {"x": "arm/grip"})


def test_rename(spark):
    names = lambda patterns: sorted(project.leaves(project.rename(record(spark), patterns).schema))
    assert names({r"cam/(.*)": r"images/\1_view", "stamp": None}) == ["arm/grip/open", "arm/grip/raw", "arm/joint", "images/front_view", "images/wrist_view"]
    assert names({r".*/raw": None, r"arm/grip/.*": "gripper", r"arm/.*": None}) == ["cam/front", "cam/wrist", "gripper", "stamp"]  # the first that matches counts
    assert names({"cam": None, "grip": "x"}) == names({})  # paths are matched whole
    assert project.rename(record(spark), {"arm/grip/raw": "spare", "arm/.*": None}).first()["spare"] is None
    for bad in ({"cam/.*": "view"}, {"stamp": "cam/front"}, {"stamp": "arm"}):
        with pytest.raises(ValueError, match="two values|both a value and a group"):
            project.rename(record(spark), bad)


def test_delta_and_absolute(spark):
    """Masked joints move by the state, the gripper and dimensions beyond the mask don't, and the way back is exact."""
    state, actions = arr(10, -4, 0.5, 7), F.array(arr(11, -4, 1, 7), arr(8.5, 0, 0, -7), arr(10, -4, 0.5, 0))
    mask = vectors.make_bool_mask(2, -1)
    moved = value(spark, vectors.delta_actions(actions, state, mask))
    assert moved == [[1, 0, 1, 7], [-1.5, 4, 0, -7], [0, 0, 0.5, 0]]
    back = F.array(*(arr(*row) for row in moved))
    assert value(spark, vectors.absolute_actions(back, state, mask)) == value(spark, actions)
    assert value(spark, vectors.absolute_actions(actions, state, None)) == value(spark, actions)
    assert [vectors.make_bool_mask(*d) for d in ((1, -3), (0, 4, -1), (-2,))] == [[True] + [False] * 3, [True] * 4 + [False], [False] * 2]


def test_prompts(spark):
    tasks = spark.createDataFrame([(3, "fold the towel"), (8, None), (9, "")], "task_index int, prompt string")
    frames_ = spark.createDataFrame([(0, 9), (1, 3), (2, 3), (3, 8)], "t int, task_index int")
    assert {r["t"]: r["prompt"] for r in joins.prompts(frames_, tasks).collect()} == {0: "", 1: "fold the towel", 2: "fold the towel", 3: None}
    for task, said in ((4, "task 4"), (None, "task null")):
        with pytest.raises(Exception, match=f"no prompt for {said}"):
            joins.prompts(spark.createDataFrame([(0, task)], "t int, task_index int"), tasks).collect()


def test_nearest_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    vals = [(int(k), float(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(-9, 9, 60), strict=True))]
    targets = [(k, t / 2) for k in range(4) for t in range(-25, 25)] + [(0, -12.5)]
    got = joins.nearest(spark.createDataFrame(targets, "k int, target double"), spark.createDataFrame([*vals, (1, None, 99)], "k int, value double, position int"), "k")
    want = {(k, t): min((abs(v - t), i, v) for j, v, i in vals if j == k)[2] for k, t in targets if k < 3}
    assert {(r["k"], r["target"]): r["nearest"] for r in got.collect()} == want


@pytest.mark.parametrize("range_rows", [10, 1000])
def test_running_total_over_ranges(spark, range_rows):
    """A key with half of all rows is parted as well, and reruns agree."""
    rows = [(5 if i % 2 else i * 7 % 101, i, i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "key int, id int, n int")
    got = aggregates.running_total(df.repartition(3), "key", F.col("n"), "before", range_rows).collect()
    again = aggregates.running_total(df.repartition(5), "key", F.col("n"), "before", range_rows).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    keys = sorted({k for k, *_ in rows})
    for key in keys:
        start = sum(n for k, _, n in rows if k < key)
        own = sorted((r["before"], r["n"]) for r in got if r["key"] == key)
        assert own[0][0] == start and {b + n for b, n in own} >= {b for b, n in own[1:] if b > start}
        assert max(b + n for b, n in own) == start + sum(n for k, _, n in rows if k == key)
    places = aggregates.dense_positions(df, ["key", "id"], range_rows).orderBy("pos").collect()
    assert [(r["key"], r["id"]) for r in places] == sorted((k, i) for k, i, _ in rows) and [r["pos"] for r in places] == list(range(300))
    assert aggregates.dense_positions(df.limit(0), "key").count() == 0


def test_merged_moments(spark):
    x = np.random.default_rng(2).normal(1e6, 1, 300)  # sums of squares would cancel
    df = spark.createDataFrame([("k", 0, float(v), i % 7) for i, v in enumerate(x)], "key string, dim bigint, value double, part int")
    parts = [aggregates.moments(df.filter(F.col("part") == p).drop("part")) for p in range(7)]
    whole = parts[0]
    for p in parts[1:]:
        whole = aggregates.merged_moments(whole.unionByName(p))
    r = whole.first()
    assert (r["mean"], r["std"], r["low"], r["high"], r["n"]) == (pytest.approx(x.mean()), pytest.approx(x.std(), rel=1e-6), x.min(), x.max(), 300)


def test_stream_stats_count_a_batch_once(spark, tmp_path):
    x = np.random.default_rng(3).normal(1e6, 1, 90)
    frame = lambda v: spark.createDataFrame([("k", 0, float(a)) for a in v], "key string, dim bigint, value double")
    path = f"file:{tmp_path}/stats"
    stats = sessions.StreamStats(spark, path)
    for epoch, part in ((0, x[:30]), (1, x[30:60]), (1, x[30:60]), (0, x[:30])):
        stats.update(frame(part), epoch)
    stats = sessions.StreamStats(spark, path)  # another driver
    stats.update(frame(x[30:60]), 1)
    stats.update(frame(x[60:]), 2)
    assert stats.moments()["k", 0] == (pytest.approx(x.mean()), pytest.approx(x.std(), rel=1e-6))


def test_stream_broker_waits_for_late_steps(spark, tmp_path):
    """Steps of an earlier time come in a later micro-batch, and still have the places of the batch form."""
    schema = "session string, t bigint, ts timestamp"
    at = lambda t: f"2024-01-01 00:{t:02d}:00"
    for i, steps in enumerate(([("a", 2), ("a", 0), ("b", 0)], [("a", 1), ("a", 4), ("b", 1)], [("a", 3), ("a", 5), ("b", 30)], [("a", 30)], [("c", 55)], [("c", 56)])):
        rows = spark.createDataFrame([(s, t, at(t)) for s, t in steps], "session string, t bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = sessions.stream_broker(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3, ts="ts", late="3 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema("session string, t bigint, position bigint, infers boolean").parquet(f"{tmp_path}/out").collect())
    want = [("a", t, i % 3, i % 3 == 0) for i, t in enumerate([0, 1, 2, 3, 4, 5, 30])] + [("b", t, i, i == 0) for i, t in enumerate([0, 1, 30])]
    assert got == want


def test_permutation_is_numpys(spark):
    got = {r["new_episode"]: r["episode"] for r in sampling.permutation(spark, 8, 42).collect()}
    assert [got[i] for i in range(8)] == np.random.default_rng(42).permutation(8).tolist()


def test_picks_are_spread_and_depend_on_the_seed(spark):
    picks = spark.range(3000).select(*(project.pick_per_episode(F.col("id"), s, 3).alias(f"s{s}") for s in (1, 2))).collect()
    for s in ("s1", "s2"):
        assert all(850 < sum(r[s] == k for r in picks) < 1150 for k in range(3))
    assert 850 < sum(r["s1"] == r["s2"] for r in picks) < 1150


def test_library_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    p = pytest.importorskip("public_tokenizers")
    encode, decode = pipelines.library_tokenizer(spark, p.path("byte_bpe_50k.json"))
    texts_ = ["pick up the cup", "", "naïve 😀\n", None]
    got = spark.createDataFrame([(t,) for t in texts_], "t string").select("t", encode("t").alias("x")).select("t", "x", decode("x").alias("back")).collect()
    tok = tokenizers.Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    assert [(r["x"], r["back"]) for r in got] == [(None if t is None else tok.encode(t, add_special_tokens=False).ids, t) for t in texts_]


def test_library_tokens_by_slices():
    """The library gets few texts at a time, and nulls keep their places."""
    sizes = []
    out = pipelines._by_slices(pd.Series(["a", None, "b"] * 50, dtype=object), lambda xs: sizes.append(len(xs)) or [x * 2 for x in xs])
    assert out.tolist() == ["aa", None, "bb"] * 50 and max(sizes) <= 32 and sum(sizes) == 100


def test_library_tokens_run_once(spark, tmp_path):
    """A table in one file is dealt out, and no call is repeated for a second use of its result."""
    from kinelake.plans import queries, registry  # noqa: F401

    if "str7_library_tokens" not in registry.QUERIES:
        pytest.skip("no tokenizers here")
    spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(8)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["str7_library_tokens"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("encode(") <= 2  # the call and its output's name
    assert [r["same_count"] for r in df.collect()] == [True] * 8


def test_library_gets_few_pieces():
    """A piece goes to the library once while it is kept; tokens and texts are the library's, whatever the texts and numbers."""
    pytest.importorskip("tokenizers")
    from types import SimpleNamespace

    from kinelake.functions import pieces

    with open(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    tok, calls = pieces.loaded(spec), []
    model = SimpleNamespace(tokenize=lambda p: calls.append(p) or tok.model.tokenize(p))
    counted = SimpleNamespace(model=model, encode_batch_fast=lambda ts, **k: calls.extend(ts) or tok.encode_batch_fast(ts, **k))
    encode = pieces.encoder(counted, spec)
    assert [len(x) for x in encode(["pick up the cup, pick up the cup"] * 50)] == [9] * 50 and len(calls) == 6
    rng = np.random.default_rng(4)
    parts = ["'s", "don't", " ", "  ", "\n", "\t", "naïve", " Straße", "東京", "한글", " 12½", "😀", "e\u0301", "<|endoftext|>", "!?", " '", "\u2028", "\x00", "Ġ", ""]
    made = ["".join(rng.choice(parts, rng.integers(9))) for _ in range(2000)]
    want = [e.ids for e in tok.encode_batch(made, add_special_tokens=False)]
    for entries in (1 << 19, 8):  # with 8, pieces are forgotten
        assert [x.tolist() for x in pieces.encoder(tok, spec, entries)(made)] == want
    ids = [rng.integers(0, 50300, rng.integers(9)).astype(np.int32) for _ in range(2000)]  # cut characters, the special one, and beyond the last
    assert pieces.decoder(tok, spec, 3)(ids) == tok.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)
    assert pieces.decoder(tok, spec)([np.array(x, np.int32) for x in want]) == tok.decode_batch(want, skip_special_tokens=False)


def test_moments_of_a_ragged_table(spark):
    """Against NumPy, with matrices beside vectors and a null that doesn't count."""
    rng = np.random.default_rng(11)
    xs, ys = rng.normal(3, 2, (37, 5)), rng.normal(-1, 0.1, (37, 2, 3))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(xs, ys, strict=True)] + [(None, None)], "x array<double>, y array<array<double>>")
    values = aggregates.dimensions(df, {"vector": F.col("x"), "matrix": F.col("y")})
    got = {(r["key"], r["dim"]): r for r in aggregates.moments(values).collect()}
    for key, want in (("vector", xs), ("matrix", ys.reshape(-1, 3))):
        for dim in range(want.shape[1]):
            r, column = got.pop((key, dim)), want[:, dim]
            assert (r["mean"], r["std"]) == (pytest.approx(column.mean()), pytest.approx(column.std()))
            assert (r["low"], r["high"], r["n"]) == (column.min(), column.max(), len(column))
    assert not got
    with pytest.raises(Exception, match="two vectors at least"):
        aggregates.norm_stats(aggregates.dimensions(df.limit(1), {"vector": F.col("x")})).collect()


def test_histogram_quantile_is_the_left_edge(spark):
    x = np.random.default_rng(0).normal(size=500)
    values = spark.createDataFrame([("k", 0, float(v)) for v in x], "key string, dim bigint, value double")
    got = aggregates.histogram_quantiles(values, {"q": 0.25}).first()["q"]
    counts, edges = np.histogram(x, np.linspace(x.min() - 1e-10, x.max() + 1e-10, 5001))
    assert abs(got - edges[np.searchsorted(counts.cumsum(), 0.25 * len(x))]) < 1e-9


def test_chunks_clamp_and_come_before_filters(spark):
    f = frames(spark, [0.0, 1.0, 2.0])
    chunks = windows.action_chunks(f, 3)
    assert [r["chunk"] for r in chunks.orderBy("t").collect()] == [[0, 1, 2], [1, 2, 2], [2, 2, 2]]
    ranges = spark.createDataFrame([("e", 0, 1)], "episode string, start int, end int")
    assert [r["chunk"] for r in filters.in_ranges(chunks, ranges).collect()] == [[0, 1, 2]]


def test_range_bounds(spark):
    f = frames(spark, [0.0] * 310)
    ranges = spark.createDataFrame([("e", 0, 100), ("e", 200, 300)], "episode string, start int, end int")
    kept = {r["t"] for r in filters.in_ranges(f, ranges).collect()}
    assert 99 in kept and 200 in kept and 100 not in kept and 300 not in kept
    assert "NestedLoop" not in filters.in_ranges(f, ranges)._jdf.queryExecution().toString()


@pytest.mark.parametrize(("parts", "expected"), [(((40, 1), (7, 0), (40, 1)), [[0, 30], [47, 77]]), (((40, 1), (6, 0), (40, 1)), [[0, 76]]), (((15, 1),), [])])
def test_keep_ranges(spark, parts, expected):
    f = windows.idle(moves(spark, *parts))
    lists = windows.range_lists(windows.keep_ranges(f), f.select("episode").distinct()).collect()
    assert [(r["episode"], [list(x) for x in r["ranges"]]) for r in lists] == [("e", expected)]


def test_unnormalize_pads(spark):
    e = 1e-6
    assert value(spark, vectors.unnormalize_z(arr(1, 1), arr(5), arr(2))) == pytest.approx([1 * (2 + e) + 5, 1 + e])
    assert value(spark, vectors.unnormalize_q(arr(0, 9), arr(0), arr(2))) == pytest.approx([0.5 * (2 + e), 9])
    with pytest.raises(Exception, match="shorter"):
        value(spark, vectors.unnormalize_q(arr(0), arr(0, 0), arr(1, 1)))


def test_digitize(spark):
    got = [value(spark, texts.digitize(F.lit(float(x)))) for x in (-2, -1, 0, 0.9921875, 1, 3, math.nan)]
    assert got == [-1, 0, 128, 255, 255, 255, 255]


def shard(spark, *rows):
    return spark.createDataFrame(rows, "suite string, category string, total_count bigint, success_count bigint")


def test_micro_and_macro(spark):
    c = aggregates.category_summary(aggregates.suite_category_sums(shard(spark, ("A", "c", 2, 1), ("B", "c", 0, 0), ("A", "overall", 2, 1)))).collect()
    assert [(r["category"], r["micro"], r["macro"], r["num_suites"]) for r in c] == [("c", 0.5, 0.5, 1)]
    c = aggregates.category_summary(aggregates.suite_category_sums(shard(spark, ("A", "c", 10, 9), ("B", "c", 2, 0)))).first()
    assert (c["micro"], c["macro"]) == (0.75, 0.45)


def test_intervals(spark):
    i = spark.createDataFrame([("s", 0, 100), ("s", 100, 200), ("s", 300, 400)], "g string, start bigint, end bigint")
    totals = spark.createDataFrame([("s", 450), ("t", 250)], "g string, total bigint")
    merged = intervals.merge(i, "g")
    assert sorted((r["start"], r["end"]) for r in merged.collect()) == [(0, 200), (300, 400)]
    missing = intervals.complement(merged, totals, "g")
    assert sorted((r["g"], r["start"], r["end"]) for r in missing.collect()) == [("s", 200, 300), ("s", 400, 450), ("t", 0, 250)]
    pieces = intervals.split(missing.filter("g = 't'"), 100)
    assert sorted((r["start"], r["end"]) for r in pieces.collect()) == [(0, 100), (100, 200), (200, 250)]


def test_temporal_alignment(spark):
    assert windows.group_deltas(range(9)) == [0, 2.5, 6.5]
    assert windows.group_deltas(range(-8, 1)) == [-8, -5.5, -1.5]
    assert [value(spark, windows.aligned_length(F.lit(n))) for n in (8, 9, 10)] == [9, 9, 13]
    assert value(spark, windows.uniform_picks(F.lit(6), 3)) == [0, 2, 5]


def test_subset_sizes(spark):
    assert [value(spark, sampling.subset_size(F.lit(50), r)) for r in (0.01, 0.05, 0.25)] == [1, 2, 12]


def test_reindex(spark):
    f = spark.createDataFrame([("b", t) for t in range(3)] + [("a", t) for t in range(2)], "episode string, t bigint")
    order = spark.createDataFrame([("b", 0), ("a", 1)], "episode string, new_episode bigint")
    got = windows.reindex(f, order).orderBy("index").collect()
    assert [(r["episode"], r["frame_index"], r["index"]) for r in got] == [("b", 0, 0), ("b", 1, 1), ("b", 2, 2), ("a", 0, 3), ("a", 1, 4)]


def test_splits(spark):
    p = spark.range(10).withColumnRenamed("id", "pos")
    count = lambda c: [r["count"] for r in p.groupBy(c.alias("w")).count().orderBy("w").collect()]
    assert count(sampling.contiguous(F.col("pos"), F.lit(10), 4)) == [2, 2, 2, 4]
    assert [r["count"] for r in sampling.strided(p, 4).groupBy("rank").count().orderBy("rank").collect()] == [3, 3, 2, 2]
    assert count(sampling.contiguous(F.col("pos"), F.lit(10), 20)) == [10]


def test_batches_drop_the_tail(spark):
    p = spark.range(10).withColumnRenamed("id", "pos")
    assert sorted(r["count"] for r in sampling.batches(p, 4).groupBy("batch").count().collect()) == [4, 4]
    with pytest.raises(ValueError):
        sampling.batches(p, 11)


def test_whole_batches(spark):
    p = spark.range(3, 113).select((F.col("id") * 37 % 1009).alias("key")).repartition(3)
    want = {r["key"] for r in sampling.batches(aggregates.dense_positions(p, "key"), 32).collect()}
    assert {r["key"] for r in sampling.whole_batches(p, 32, "key").collect()} == want and len(want) == 96
    assert sampling.whole_batches(p, 10, "key").count() == 110
    with pytest.raises(ValueError):
        sampling.whole_batches(p, 111, "key")


def test_logging_windows(spark):
    steps = spark.range(201).select(F.col("id").alias("step"), F.lit(1.0).alias("loss"))
    assert [r["steps"] for r in aggregates.logged_means(steps, 100, ["loss"], []).orderBy("window").collect()] == [1, 100, 100]


def test_broker(spark):
    s = spark.createDataFrame([("s", t) for t in range(7)], "session string, t bigint")
    got = sessions.broker_positions(s, 3).orderBy("t").collect()
    assert [r["position"] for r in got] == [0, 1, 2, 0, 1, 2, 0]
    assert [r["t"] for r in got if r["infers"]] == [0, 3, 6]


@pytest.mark.parametrize(("h", "w", "to"), [(480, 640, (224, 224)), (7, 91, (32, 16)), (1000, 3, (48, 64)), (121, 121, (11, 11)), (224, 224, (224, 224))])
def test_image_geometry(spark, h, w, to):
    """The picture keeps its shape as far as whole pixels go, touches two edges, and lies in the middle."""
    g = spark.range(1).select(*(c.alias(n) for n, c in texts.resize_with_pad(F.lit(h), F.lit(w), *to).items())).first()
    assert (g["top"] + g["height"] + g["bottom"], g["left"] + g["width"] + g["right"]) == to
    scale = min(to[0] / h, to[1] / w)
    assert abs(g["height"] - h * scale) <= 1 and abs(g["width"] - w * scale) <= 1
    assert g["height"] == to[0] or g["width"] == to[1]
    assert 0 <= g["bottom"] - g["top"] <= 1 and 0 <= g["right"] - g["left"] <= 1


@pytest.mark.parametrize("x", [1, 1.5, "hé", True, None, b"ab", [1, [2.0]], {"a": {"b": 1}}, float("inf"), np.float32(2), np.arange(6, dtype=np.int16).reshape(2, 3), np.array([math.nan]), np.array(["a", "bc"]), np.array(True)])
def test_wire(x):
    got = wire.loads(wire.dumps(x))
    if isinstance(x, (np.ndarray, np.generic)):
        assert got.dtype == x.dtype and got.shape == x.shape
        np.testing.assert_array_equal(got, x)
    else:
        assert got == x


def test_wire_in_small_batches(spark):
    """Whole texts go to Python a thousand at a time, so a worker's memory doesn't grow with the table."""
    from kinelake.plans import queries, registry  # noqa: F401

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        registry.QUERIES["wire1_arrays"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, before)


def test_wire_rejects_objects():
    with pytest.raises(ValueError):
        wire.dumps(np.array([object()]))


def test_mixture_weights(spark):
    with pytest.raises(ValueError):
        sampling.quota_mixture(spark.range(1), {"a": 0.5}, 10)
    df = spark.createDataFrame([("a", 0), ("a", 1)], "dataset string, pos bigint")
    with pytest.raises(ValueError, match="no rows to draw from in \\['b'\\]"):
        sampling.quota_mixture(df, {"a": 0.5, "b": 0.5}, 10)
    assert sampling.quota_mixture(df, {"a": 1.0, "b": 0.0}, 10).count() == 10


def test_outputs_need_statistics(spark):
    df = spark.range(1).select(arr(1).alias("state"))
    stats = {"actions": {"mean": [0.0], "std": [1.0]}}
    assert df.transform(pipelines.normalize(stats, False)).columns == ["state"]
    with pytest.raises(ValueError):
        df.transform(pipelines.normalize(stats, False, inverse=True))
    with pytest.raises(ValueError):
        pipelines.normalize(stats, True)


SHARDS = os.environ.get("EVAL_SHARDS", "")


@pytest.mark.skipif(not os.path.isdir(SHARDS), reason="EVAL_SHARDS names no folder of evaluation shards <suite>/<start>_<end>.json")
def test_evaluation_shards(spark):
    """``EVAL_TOTAL``: success/total over all suites; the intervals cover as many tasks as were counted."""
    success, total = map(int, os.environ["EVAL_TOTAL"].split("/"))
    files = spark.createDataFrame([(p, open(p).read()) for p in glob.glob(f"{SHARDS}/*/*.json")], "path string, value string")
    s = readers.shards(files).cache()
    found = aggregates.suite_overall(aggregates.suite_category_sums(s)).filter("suite IS NULL").first()
    assert (found["success"], found["total"]) == (success, total)
    spans = s.select("suite", "start", "end").distinct()
    assert intervals.merge(spans, "suite").agg(F.sum(F.col("end") - F.col("start"))).first()[0] == total
