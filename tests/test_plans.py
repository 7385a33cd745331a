"""The plans that queries are meant to have."""

import re

import pytest
from pyspark.sql import functions as F

from kinelake.operators import aggregates, filters, project, windows
from kinelake.plans import queries as _filled  # noqa: F401
from kinelake.plans.registry import QUERIES, table, traj
from kinelake.sources import shared


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    p = plan(table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select("l_orderkey"))
    assert "GreaterThan(l_quantity,25.0)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p


def test_repack_prunes(spark, sf_dir):
    nested = table(spark, sf_dir, "orders").select("o_orderkey", F.struct("o_totalprice", "o_orderpriority").alias("obs"))
    p = plan(project.repack(nested, {"x": {"price": "obs/o_totalprice"}}))
    assert "ReadSchema: struct<o_totalprice:double>" in p


def test_windows_of_an_episode_share_a_shuffle(spark, sf_dir):
    f = windows.action_chunks(traj(spark, sf_dir), 4, action="value")
    f = windows.idle(f.withColumn("vector", F.array("value")))
    f = windows.at_offsets(f, [-1, 0, 1], value="value")
    assert len(re.findall(r"Exchange hashpartitioning", plan(f))) == 1


def test_ranges_join_by_key(spark, sf_dir):
    r = spark.createDataFrame([(1, 0, 5)], "episode bigint, start int, end int")
    p = plan(filters.in_ranges(traj(spark, sf_dir), r))
    assert "NestedLoop" not in p and "CartesianProduct" not in p


#: These gather what is small by meaning: totals and summaries, orders of names, the k rows asked for.
SMALL = re.compile("agg9|agg16|agg20|agg23|ord12|ord13|ord14|ord16|snk3|snk9|snk10|win6|ord3|fil13|agg24|agg12|fil12|pipe1")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_scale(spark, sf_dir, name, monkeypatch):
    """No nested loops, but for one row of statistics; no window or sort of everything in one task.

    Ranges are small, so that these tables have several, as large ones do.
    """
    monkeypatch.setattr(aggregates, "RANGE_ROWS", 4)
    p = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in p and ("BroadcastNestedLoop" not in p or name == "pipe1_chunk_delta_normalize")
    if SMALL.match(name):
        return
    lines = p.splitlines()
    for above, line in zip(lines, lines[1:], strict=False):
        if "Exchange SinglePartition" in line:  # partial aggregates are merged there, and nothing else
            assert ("Aggregate" in above or "InputAdapter" in above) and "Window" not in above and "Sort" not in above, above


def test_masks_of_long_episodes_are_whole(spark):
    """10,020 events of one user, the first without k; and a user with fewer than the prefix."""
    d = shared.new_path(spark, "sf")
    e = spark.range(10_023).selectExpr("id AS event_id", "if(id < 10020, 1, 2) AS user_id", "timestamp_seconds(id) AS ts", "'view' AS event_type", "0.5D AS value", """if(id = 0, '{}', '{"k": 1}') AS props""")
    e.write.parquet(f"{d}/events.parquet")
    got = sorted(tuple(r) for r in QUERIES["str6_masks"](spark, d).collect())
    assert got == [(u, t, int(t >= 10), int(t >= 10)) for u, n in ((1, 10_020), (2, 3)) for t in range(n)]


FEW = r"(?:dim|key|dataset|suite|event_type|name|g)#\d+L?"


@pytest.mark.parametrize("name", ["agg2_histogram_quantiles", "agg4_norm_stats_job", "agg10_latency_quantiles", "ord4_quota_mixture", "ord4_interleaved", "int1_merge", "int2_complement", "int3_coverage", "ord15_nearest_candidate"])
def test_few_keys_gather_no_rows(spark, sf_dir, name, monkeypatch):
    """What is dealt out by a key of few values alone is summed up already, so no task gets a key's rows."""
    monkeypatch.setattr(aggregates, "RANGE_ROWS", 4)
    lines = plan(QUERIES[name](spark, sf_dir)).splitlines()
    for line, below in zip(lines, lines[1:], strict=False):
        if re.search(rf"Exchange hashpartitioning\({FEW}(?:, {FEW})*, \d+\)", line):
            assert "Aggregate" in below, f"{line}\n{below}"
