"""Windows along episodes, and filters on frames."""

from pyspark.sql import functions as F

from kinelake.operators import aggregates, filters, windows
from kinelake.plans.registry import exploded, long, query, r6, table, traj, vectors


@query("""WITH {traj}, n AS (SELECT episode, max(t) AS last FROM traj GROUP BY episode)
SELECT a.episode, a.t, k.k AS pos, b.value AS v FROM traj a JOIN n USING (episode), (SELECT unnest(range(8)) AS k) k, traj b
WHERE b.episode = a.episode AND b.t = least(a.t + k.k, n.last)""")
def win1_action_chunks(spark, d):
    return exploded(windows.action_chunks(traj(spark, d), 8, action="value"), "chunk", "episode", "t")


@query("""WITH {traj}, n AS (SELECT episode, max(t) AS last FROM traj GROUP BY episode)
SELECT a.episode, a.t, k.k AS pos, b.value AS v FROM traj a JOIN n USING (episode), (SELECT unnest(range(8)) AS k) k, traj b
WHERE b.episode = a.episode AND b.t = least(a.t + k.k, n.last)""")
def win1_trajectory_chunks(spark, d):
    """The same by a function of the episode, which sees it as a stream of batches."""
    from kinelake.operators.trajectories import chunker, trajectory_map

    f = trajectory_map(traj(spark, d).select("episode", "t", "value"), chunker(8, "value"), "episode bigint, t bigint, chunk array<double>")
    return exploded(f, "chunk", "episode", "t")


#: Movement in coarse steps, so that there are idle frames; rounding keeps halves out.
MOVES = "array(floor(value / 60), floor(k / 50))"
IDLE = """moves AS (SELECT episode, t, floor(value / 60) AS a, floor(k / 50) AS b FROM traj),
flags AS (SELECT episode, t, coalesce(abs(a - lag(a) OVER w) < 0.001 AND abs(b - lag(b) OVER w) < 0.001, false) AS idle
  FROM moves WINDOW w AS (PARTITION BY episode ORDER BY t))"""
ISLANDS = IDLE + """, marked AS (SELECT *, CASE WHEN idle = lag(idle) OVER w THEN 0 ELSE 1 END AS n FROM flags WINDOW w AS (PARTITION BY episode ORDER BY t)),
numbered AS (SELECT *, sum(n) OVER (PARTITION BY episode ORDER BY t) AS run FROM marked)"""
KEPT = ISLANDS + """, sized AS (SELECT *, NOT (idle AND count(*) OVER (PARTITION BY episode, run) >= 2) AS kept FROM numbered),
marked2 AS (SELECT episode, t, kept, CASE WHEN kept = lag(kept) OVER w THEN 0 ELSE 1 END AS n FROM sized WINDOW w AS (PARTITION BY episode ORDER BY t)),
numbered2 AS (SELECT *, sum(n) OVER (PARTITION BY episode ORDER BY t) AS run FROM marked2),
kept AS (SELECT episode, min(t) AS s, max(t) + 1 AS e FROM numbered2 WHERE kept GROUP BY episode, run HAVING count(*) >= 6)"""


def idle_flags(spark, d):
    return windows.idle(traj(spark, d).withColumn("vector", F.expr(MOVES)))


def ranges(spark, d):
    return windows.keep_ranges(idle_flags(spark, d), least_idle=2, least_kept=6, cut=2)


@query("WITH {traj}, " + IDLE + " SELECT episode, t, idle FROM flags")
def win2_idle_flag(spark, d):
    return idle_flags(spark, d).select("episode", "t", "idle")


@query("WITH {traj}, " + ISLANDS + " SELECT episode, min(t) AS start, max(t) + 1 AS \"end\" FROM numbered WHERE idle GROUP BY episode, run HAVING count(*) >= 2")
def win3_idle_runs(spark, d):
    return windows.runs(idle_flags(spark, d), "idle").filter(F.col("idle") & (F.col("end") - F.col("start") >= 2)).select("episode", "start", "end")


@query("WITH {traj}, " + KEPT + " SELECT e.episode, coalesce(s, -1) AS start, coalesce(e - 2, -1) AS \"end\" FROM (SELECT DISTINCT episode FROM traj) e LEFT JOIN (SELECT episode, s, e FROM kept) k USING (episode)")
def win4_keep_ranges(spark, d):
    return traj(spark, d).select("episode").distinct().join(ranges(spark, d), "episode", "left").fillna(-1)


@query("WITH {traj}, " + KEPT + " SELECT e.episode, count(s) AS n_ranges, coalesce(sum(e.e - 2 - e.s), 0)::BIGINT AS frames FROM (SELECT x.episode, s, e FROM (SELECT DISTINCT episode FROM traj) x LEFT JOIN kept USING (episode)) e GROUP BY e.episode")
def win4_range_lists(spark, d):
    lists = windows.range_lists(ranges(spark, d), traj(spark, d).select("episode").distinct())
    frames = F.aggregate("ranges", F.lit(0).cast("long"), lambda a, r: a + r[1] - r[0])
    return lists.select("episode", long(F.size("ranges")).alias("n_ranges"), frames.alias("frames"))


ORDER = """ep AS (SELECT episode, count(*) AS length FROM traj GROUP BY episode),
ord AS (SELECT episode, length, row_number() OVER (ORDER BY (episode * 7919 + 42 * 104729 + episode % 97 * 15485863) % 2147483647, episode) - 1 AS new_episode FROM ep)"""


def episode_order(spark, d):
    from kinelake.operators.aggregates import dense_positions
    from kinelake.operators.sampling import shuffle_key

    ep = traj(spark, d).groupBy("episode").agg(F.count("*").alias("length")).withColumn("at", shuffle_key(F.col("episode"), 42))
    return dense_positions(ep, ["at", "episode"]).select("episode", "length", F.col("pos").alias("new_episode"))


@query("WITH {traj}, " + ORDER + """ SELECT episode, t, new_episode, t AS frame_index,
(before + t)::BIGINT AS index
FROM (SELECT episode, new_episode, sum(length) OVER (ORDER BY new_episode) - length AS before FROM ord) o JOIN (SELECT episode, t FROM traj) USING (episode)""")
def win5_reindex(spark, d):
    order = episode_order(spark, d)
    return windows.reindex(traj(spark, d).select("episode", "t"), order.select("episode", "new_episode")).select("episode", "t", "new_episode", "frame_index", "index")


@query("WITH {traj}, ep AS (SELECT episode, count(*) AS length FROM traj GROUP BY episode), o AS (SELECT *, sum(length) OVER (ORDER BY episode) - length AS off FROM ep)\n"
       "SELECT episode, k, floor((k + 0.5) * (length - 1) / 4)::BIGINT AS frame, (off + floor((k + 0.5) * (length - 1) / 4))::BIGINT AS index FROM o, (SELECT unnest(range(4)) AS k) x")
def win6_spread_picks(spark, d):
    return windows.spread_picks(traj(spark, d).groupBy("episode").agg(F.count("*").alias("length")), 4)


@query("WITH {traj}, ep AS (SELECT episode, count(*) AS n FROM traj GROUP BY episode) SELECT episode, k AS pos, round_even(k * (n - 1) / 6.0, 0)::BIGINT AS v FROM ep, (SELECT unnest(range(7)) AS k) x")
def win7_uniform_picks(spark, d):
    ep = traj(spark, d).groupBy("episode").agg(F.count("*").alias("n"))
    return exploded(ep.withColumn("x", windows.uniform_picks(F.col("n"), 7)), "x", "episode")


@query("WITH {traj}, ep AS (SELECT episode, count(*) AS n FROM traj GROUP BY episode) SELECT episode, n, ((n + 2) // 4) * 4 + 1 AS aligned, ((n + 1) // 2) * 2 AS tubelets FROM ep")
def win8_win11_alignment(spark, d):
    ep = traj(spark, d).groupBy("episode").agg(F.count("*").alias("n"))
    return ep.select("episode", "n", long(windows.aligned_length(F.col("n"))).alias("aligned"), long(windows.tubelet_length(F.col("n"), 2)).alias("tubelets"))


@query("""WITH {traj}, n AS (SELECT episode, count(*) AS n, max_by(value, t) AS last FROM traj GROUP BY episode)
SELECT episode, count(*) AS length, round(sum(v), 6) AS total FROM (SELECT episode, value AS v FROM traj UNION ALL
SELECT episode, last AS v FROM n, range(4) r(i) WHERE i < ((n + 2) // 4) * 4 + 1 - n) GROUP BY episode""")
def win8_pad_last(spark, d):
    seq = traj(spark, d).groupBy("episode").agg(F.array_sort(F.collect_list(F.struct("t", "value"))).alias("s")).select("episode", F.col("s.value").alias("v"))
    padded = seq.withColumn("v", windows.pad_last(F.col("v"), windows.aligned_length(F.size("v"))))
    return padded.select("episode", long(F.size("v")).alias("length"), r6(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("WITH {traj} SELECT episode, ceil(t / 4.0)::BIGINT AS \"group\", round(avg(value), 6) AS value FROM traj GROUP BY 1, 2")
def win9_temporal_pool(spark, d):
    return windows.temporal_pool(traj(spark, d), "value").select("episode", "group", r6("value").alias("value"))


@query("SELECT * FROM (VALUES (0, 0, 0.0), (0, 1, 2.5), (0, 2, 6.5), (1, 0, -8.0), (1, 1, -5.5), (1, 2, -1.5)) v(list, pos, delta)".replace("SELECT *", "SELECT list::BIGINT AS list, pos::BIGINT AS pos, delta::DOUBLE AS delta"))
def win10_group_deltas(spark, d):
    lists = [windows.group_deltas(range(9)), windows.group_deltas(range(-8, 1))]
    return spark.createDataFrame([(i, p, v) for i, x in enumerate(lists) for p, v in enumerate(x)], "list bigint, pos bigint, delta double")


@query("""WITH {traj}, n AS (SELECT episode, max(t) AS last FROM traj GROUP BY episode)
SELECT a.episode, a.t, o.i AS pos, b.value AS v FROM traj a JOIN n USING (episode), (VALUES (0, -8), (1, -4), (2, 0), (3, 4)) o(i, off), traj b
WHERE b.episode = a.episode AND b.t = greatest(0, least(a.t + o.off, n.last))""".replace("o.i AS pos", "o.i::BIGINT AS pos"))
def win12_offsets(spark, d):
    return exploded(windows.at_offsets(traj(spark, d), [-8, -4, 0, 4], value="value"), "values", "episode", "t")


@query("SELECT vec_id, pos, round(exp(-0.1 * pos) / 8.396425892405, 6) AS v FROM embeddings, (SELECT unnest(range(64)) AS pos) x".replace("8.396425892405", "(SELECT sum(exp(-0.1 * i)) FROM range(64) r(i))"))
def win13_decay_weights(spark, d):
    return exploded(vectors(spark, d).withColumn("w", windows.decay_weights(F.col("x"), 0.1)), "w", "vec_id").withColumn("v", r6("v"))


TOKENS = "tok AS (SELECT episode AS seq, t AS pos, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS ar, k % 5 <> 0 AS valid FROM traj)"


def tokens(spark, d):
    return traj(spark, d).select(F.col("episode").alias("seq"), F.col("t").alias("pos"), F.expr("CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END").alias("ar"), F.expr("k % 5 <> 0").alias("valid"))


@query("WITH {traj}, " + TOKENS + ", c AS (SELECT *, sum(ar) OVER (PARTITION BY seq ORDER BY pos) AS b FROM tok) SELECT x.seq, x.pos AS i, y.pos AS j, y.b <= x.b AND x.valid AND y.valid AS attends FROM c x JOIN c y ON x.seq = y.seq")
def win14_causal_mask(spark, d):
    return windows.causal_mask(tokens(spark, d))


@query("WITH {traj}, " + TOKENS + ", c AS (SELECT *, sum(ar) OVER (PARTITION BY seq ORDER BY pos) AS b FROM tok), e AS (SELECT seq, b, max(pos) + 1 AS e FROM c GROUP BY 1, 2) SELECT seq, pos AS i, CASE WHEN e > (SELECT max(pos) FROM c y WHERE y.seq = c.seq) THEN -1 ELSE e END AS \"end\", valid FROM c JOIN e USING (seq, b)")
def win14_causal_prefixes(spark, d):
    return windows.causal_prefixes(tokens(spark, d)).withColumn("end", F.coalesce("end", F.lit(-1).cast("long")))


@query("WITH {traj}, " + TOKENS + ", c AS (SELECT *, sum(ar) OVER (PARTITION BY seq ORDER BY pos) AS b FROM tok) SELECT x.seq, x.pos AS i, y.pos AS j FROM c x JOIN c y ON x.seq = y.seq WHERE y.b <= x.b AND x.valid AND y.valid")
def win14_expanded_mask(spark, d):
    return windows.expand_mask(windows.causal_prefixes(tokens(spark, d)), windows.valid_runs(tokens(spark, d)))


@query("WITH {traj}, " + TOKENS + " SELECT seq, pos, (sum(CASE WHEN valid THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY pos) - 1)::BIGINT AS position_id FROM tok")
def win15_position_ids(spark, d):
    return windows.position_ids(tokens(spark, d)).select("seq", "pos", "position_id")


@query("WITH {traj}, " + TOKENS + """, l AS (SELECT seq, count(*) AS n, coalesce(max(CASE WHEN valid THEN pos END) + 1, 0) AS m FROM tok GROUP BY seq)
SELECT seq, (pos - m + n) % n AS pos, pos AS v FROM tok JOIN l USING (seq)""")
def win16_align_right(spark, d):
    s = tokens(spark, d).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "valid"))).alias("s"))
    return exploded(s.withColumn("a", windows.align_right(F.col("s.pos"), F.col("s.valid"))), "a", "seq")


RANGES = "(SELECT episode, s, e FROM (SELECT DISTINCT episode FROM traj), (VALUES (0, 10), (20, 30)) r(s, e) WHERE episode % 3 <> 0)"


def range_table(spark, d):
    r = F.explode(F.expr("array(struct(0L AS start, 10L AS end), struct(20L AS start, 30L AS end))")).alias("r")
    return traj(spark, d).select("episode").distinct().filter("episode % 3 <> 0").select("episode", r).select("episode", "r.start", "r.end")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, 'example')")
def fil1_success(spark, d):
    return table(spark, d, "pages").filter(F.col("url").rlike("example")).select("page_id", "url")


@query("WITH {traj} SELECT episode, t, value FROM traj WHERE EXISTS (SELECT 1 FROM " + RANGES + " r WHERE r.episode = traj.episode AND t >= s AND t < e)")
def fil2_in_ranges(spark, d):
    return filters.in_ranges(traj(spark, d), range_table(spark, d)).select("episode", "t", "value")


@query("WITH {traj}, n AS (SELECT episode, max(t) AS last FROM traj GROUP BY episode) SELECT a.episode, a.t, k.k AS pos, b.value AS v FROM traj a JOIN n USING (episode), (SELECT unnest(range(4)) AS k) k, traj b\n"
       "WHERE b.episode = a.episode AND b.t = least(a.t + k.k, n.last) AND EXISTS (SELECT 1 FROM " + RANGES + " r WHERE r.episode = a.episode AND a.t >= s AND a.t < e)")
def fil2_chunk_then_filter(spark, d):
    chunks = windows.action_chunks(traj(spark, d), 4, action="value")
    return exploded(filters.in_ranges(chunks, range_table(spark, d)), "chunk", "episode", "t")


@query("WITH {traj} SELECT count(*) AS n FROM traj")
def fil3_fil4_no_ranges(spark, d):
    return filters.in_ranges(traj(spark, d), None).drop("ts").agg(F.count("*").alias("n"))


@query("WITH {traj} SELECT episode, t FROM traj WHERE t < coalesce((SELECT min(t) FROM traj b WHERE b.episode = traj.episode AND b.event_type = 'error'), 1000000)")
def fil5_until_failure(spark, d):
    return filters.until_failure(traj(spark, d).withColumn("ok", F.col("event_type") != "error"), "ok").select("episode", "t")


@query("WITH {traj} SELECT episode, t FROM traj WHERE coalesce(CASE WHEN k >= 20 THEN k >= 50 END, true)")
def fil6_moving(spark, d):
    f = traj(spark, d).withColumn("movement_enabled", F.expr("CASE WHEN k >= 20 THEN k >= 50 END"))
    return filters.moving(f, "movement_enabled", remove_skipped=True).select("episode", "t")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS n_wrist, count(*) FILTER (o_orderstatus <> 'O') AS n_exterior FROM orders GROUP BY 1")
def fil7_by_kind(spark, d):
    kinds = F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1))))
    m = table(spark, d, "orders").groupBy("o_custkey").agg(kinds.alias("m"))
    return m.select("o_custkey", long(F.size(filters.by_kind(F.col("m"), True))).alias("n_wrist"), long(F.size(filters.by_kind(F.col("m"), False))).alias("n_exterior"))


@query("WITH {traj} SELECT event_type, count(*) AS n FROM traj WHERE event_type <> 'view' GROUP BY 1")
def fil8_without_overall(spark, d):
    rows = traj(spark, d).select(F.lit("s").alias("suite"), F.when(F.col("event_type") == "view", "overall").otherwise(F.col("event_type")).alias("category"), F.lit(1).alias("total_count"), F.lit(1).alias("success_count"))
    return aggregates.suite_category_sums(rows).select(F.col("category").alias("event_type"), F.col("total").alias("n"))


@query("SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def fil9_join6_not_done(spark, d):
    done = table(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("key"))
    return filters.not_done(table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), done)


@query("SELECT p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_linenumber) >= 7)")
def fil10_not_done_in_all(spark, d):
    done = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("block"))
    return filters.not_done_in_all(table(spark, d, "part").select(F.col("p_partkey").alias("key")), done, 7)


@query("""WITH c AS (SELECT event_id, greatest(0, least(user_id, 100)) AS s, CASE WHEN event_id % 7 = 0 THEN 100 ELSE greatest(0, least(event_id % 120, 100)) END AS e FROM events)
SELECT event_id, s AS start, e AS "end" FROM c WHERE s < e""")
def fil11_clamped(spark, d):
    e = table(spark, d, "events").withColumn("e", F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("event_id") % 120))
    s, t = filters.clamped(F.col("user_id"), F.col("e"), F.lit(100).cast("long"))
    return e.select("event_id", s.alias("start"), long(t).alias("end")).filter(F.col("start") < F.col("end"))


@query("SELECT page_id FROM pages WHERE regexp_full_match(url, 'https?://[a-z.]*example\\.(com|org)/en/.*')")
def fil12_path_matches(spark, d):
    return table(spark, d, "pages").filter(filters.path_matches(F.col("url"), r"https?://[a-z.]*example\.(com|org)/en/.*")).select("page_id")


@query("SELECT max(CASE WHEN regexp_full_match(n, '[0-9]+') THEN n::BIGINT END) AS latest FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey::VARCHAR ELSE 'tmp_' || o_orderkey END AS n FROM orders)")
def fil13_latest(spark, d):
    n = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey").cast("string")).otherwise(F.concat(F.lit("tmp_"), F.col("o_orderkey").cast("string")))
    return table(spark, d, "orders").agg(filters.latest_number(n).alias("latest"))
