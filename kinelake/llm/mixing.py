"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash of its id and text. A source's budget is met by a
threshold: documents with a smaller hash are in, and a larger budget takes a
superset, so mixes are nested. The threshold is found without sorting documents. Sizes are
summed by source and the first 12 bits of the hash; the bucket in which the
budget runs out is the only one looked into, by its next 12 bits, and so on;
the documents left in the last bucket are settled by their whole hash. Rows that
repeat id and text share it; if the budget runs out among those, so many of them
are taken, by a place that they are given within the parts of the table. Every
pass is one aggregation over a small table (id, source, size, hash), combined
on the map side, so a hot source costs no more than another.

Only DataFrame functions run on the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinelake.llm import common

BITS, LEVELS, WHOLE = 12, 3, 60


def row_hash(id_col: Column, text_col: Column, seed: str) -> Column:
    """60 bits of the MD5 of id, seed and text: the same in any engine. Null counts as empty."""
    whole = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.coalesce(text_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, WHOLE // 4), 16, 10).cast("long")


def fill_targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, weigh ``weights``, repeating. The budget
    is ``share`` of all sizes. A target stops at ``most`` times its source's
    size and the excess is dealt out again by weight; the end of that is one
    level L with target = min(most * size, L * weight). Sources are taken by
    most * size / weight; L is the first at which those before are full.

    One task sorts the sources, a row of some 40 bytes each: as many as there
    are names, which doesn't grow with the documents of a source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    n = F.lit(len(weights))
    weighed = sources.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")))
    weighed = weighed.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = F.greatest(left, F.lit(0.0)) / F.sum("w").over(after)
    # The first source that isn't full at its level gives the level of all that follow.
    leveled = weighed.withColumn("level", F.when(level < F.col("ratio"), level))
    target = F.least("cap", F.coalesce(F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) * F.col("w"), F.col("cap")))
    return leveled.select("source", "source_size", target.cast("double").alias("target"))


def mix_plan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The table of ids, sources, sizes and hashes, and the plan: a row a source.

    The plan has ``s`` (the source), ``source_size``, ``target``, ``times`` (how
    often the mix takes every document), ``bound`` (the largest hash that it takes
    once more), and ``edge``, ``ties`` (the hash of which it takes that many of
    several rows once more; else null).
    """
    words = F.regexp_count(F.coalesce(df[text_col].cast("string"), F.lit("")), F.lit(common.WORD))
    sized = common.staged(df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), words.cast("long").alias("size"), row_hash(df[id_col], df[text_col], seed).alias("h"), F.monotonically_increasing_id().alias("row")), "sized")
    totals = common.staged(fill_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), list(weights), share, most).coalesce(1), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = totals.withColumn("times", whole).withColumn("left", F.col("target") - F.col("times") * F.col("source_size")).withColumnRenamed("source", "g")
    bounds = find_bounds(sized, goals.select(F.col("g").alias("source"), "left"))
    plan = goals.join(bounds, goals["g"].eqNullSafe(bounds["s"]), "left").select(F.col("g").alias("s"), "source_size", "target", "times", "bound", "edge", "ties")
    return sized, common.staged(plan.coalesce(1), "plan")  # its size is known: small enough is broadcast


def copies(h: Column, times: Column, bound: Column) -> Column:
    """How often the mix takes a document of hash ``h``, by its source's plan."""
    return times + F.coalesce((h <= bound).cast("long"), F.lit(0))


def placed_ties(tied: DataFrame) -> DataFrame:
    """``tied`` rows of the columns ``s`` and ``row`` with ``nth``: their place, from 0, among those of their ``s``.

    ``row`` numbers the rows of a staged table; its upper bits are the part of the
    table. Rows are numbered within a part, after the counts of the parts before,
    so that no task gathers all that repeat one text.
    """
    part = F.shiftright("row", 33)
    counts = tied.groupBy("s", part.alias("part")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part of the table
    first = counts.select(F.col("s").alias("__s"), F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("s", "__of").orderBy("row")) - 1
    own = tied.withColumn("__of", part).withColumn("__within", within)
    return own.join(first, F.col("s").eqNullSafe(F.col("__s")) & (F.col("__of") == F.col("__part"))).withColumn("nth", F.col("__first") + F.col("__within")).drop("__s", "__part", "__first", "__of", "__within")


def mix_sources(df: DataFrame, **options) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken``. Options: as of ``mix_plan``.

    ``size`` counts words; ``taken`` is the size times how often the mix takes
    the document: every document of its source as often as the target holds the
    source whole, and once more below the threshold at which the rest is nearest
    to used up. Ids may lack or repeat: texts tell rows apart, and of rows that
    repeat both some may be taken once more than others. Null and empty texts have size 0 and take nothing; null is a source of its
    own, the last; an empty table gives no rows; other columns are not read.
    """
    sized, plan = mix_plan(df, **options)
    joined = sized.join(plan, sized["source"].eqNullSafe(plan["s"]), "left")
    own = ["doc_id", "size", "source_size", "target"]
    often = copies(F.col("h"), F.col("times"), F.col("bound"))
    if plan.filter("edge IS NOT NULL").isEmpty():
        return joined.select(*own, (F.col("size") * often).alias("taken"))
    tied = F.coalesce(F.col("h") == F.col("edge"), F.lit(False))
    split = placed_ties(joined.filter(tied)).select(*own, (F.col("size") * (F.col("times") + (F.col("nth") < F.col("ties")).cast("long"))).alias("taken"))
    return joined.filter(~tied).select(*own, (F.col("size") * often).alias("taken")).unionByName(split)


def mixed(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **options) -> DataFrame:
    """The rows of ``df`` that the mix takes, with ``copies``: how often. No text is shuffled, but of rows that repeat id and text where the budget ends among those."""
    _, plan = mix_plan(df, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, **options)
    own = [c for c in df.columns if c != "copies"]
    of, times, bound, edge, ties, h = (common.free(df, x) for x in ("of_source", "times", "bound", "edge", "ties", "h"))
    plan = plan.select(F.col("s").alias(of), F.col("times").alias(times), F.col("bound").alias(bound), F.col("edge").alias(edge), F.col("ties").alias(ties))
    joined = df.withColumn(h, row_hash(F.col(id_col), F.col(text_col), seed)).join(plan, F.col(source_col).eqNullSafe(F.col(of)))
    often = copies(F.col(h), F.col(times), F.col(bound))
    if plan.filter(F.col(edge).isNotNull()).isEmpty():
        return joined.withColumn("copies", often).filter("copies > 0").select(*own, "copies")
    tied = F.coalesce(F.col(h) == F.col(edge), F.lit(False))
    rows = common.staged(joined.filter(tied).select(F.struct(*own).alias("r"), F.col(of).alias("s"), F.col(times).alias("times"), F.col(ties).alias("ties"), F.monotonically_increasing_id().alias("row")), "ties")
    split = placed_ties(rows).withColumn("copies", F.col("times") + (F.col("nth") < F.col("ties")).cast("long")).filter("copies > 0").select("r.*", "copies")
    return joined.filter(~tied).withColumn("copies", often).filter("copies > 0").select(*own, "copies").unionByName(split)


def find_bounds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """``s, bound, edge, ties``: the source, the largest hash that its budget ``left`` takes (none where it takes nothing), and how many of the rows of the next hash, if those are several.

    A document is in when half its size still fits, so the sum ends nearest to the budget.
    """
    state = goals.select(F.col("source").alias("s"), "left", F.lit(0).cast("long").alias("at"))  # at: prefix of the boundary bucket
    rows, known = sized, 0
    for bits in [*[BITS] * LEVELS, WHOLE - BITS * LEVELS]:
        known += bits
        last, part = known == WHOLE, F.shiftright("h", WHOLE - known)
        same = rows["source"].eqNullSafe(state["s"]) & (F.shiftright(rows["h"], WHOLE - known + bits) == state["at"])
        sums = rows.join(state, same).groupBy("s", "left", part.alias("p")).agg(F.sum("size").alias("n"), F.count("*").alias("m"))
        order = Window.partitionBy("s").orderBy("p")
        sums = sums.withColumn("upto", F.sum("n").over(order))
        if last:
            each = F.col("n") / F.col("m")  # rows of one hash have one text, so one size
            fits = F.col("upto") - each / 2 <= F.col("left")
            some = F.floor((F.col("left") - F.col("upto") + F.col("n")) / F.nullif(each, F.lit(0.0)) + 0.5).cast("long")
            open_ = F.when(~fits & (some > 0) & (some < F.col("m")), F.struct(F.col("p").alias("edge"), some.alias("ties")))
            taken = sums.groupBy("s").agg(F.max(F.when(fits, F.col("p"))).alias("inside"), F.min(open_).alias("open"))
            joined = state.join(taken.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t")), "left")
            return joined.select("s", F.coalesce("inside", F.shiftleft("at", WHOLE - known + bits) - 1).alias("bound"), "open.edge", "open.ties")
        # The boundary is the first bucket in which the sum reaches the budget, or else the last one.
        pick = F.min_by(F.struct("p", "upto", "n"), F.struct((F.col("upto") < F.col("left")).cast("int"), F.when(F.col("upto") < F.col("left"), -F.col("p")).otherwise(F.col("p"))))
        found = sums.groupBy("s", "left").agg(pick.alias("b"))
        state = common.staged(found.select("s", (F.col("left") - F.col("b.upto") + F.col("b.n")).alias("left"), F.col("b.p").alias("at")).coalesce(1), "bounds")
    raise AssertionError("the last level returns")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(common.read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix:' || coalesce(text, '')), 1, 15))::BIGINT AS h, row_number() OVER () AS r
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
         ([3.0, 1.0, 2.0])[(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source),
rounds AS (
  SELECT 0 AS k, source, source_size, cap, w, 0.0::DOUBLE AS target, false AS done FROM sources
  UNION ALL
  SELECT k + 1, source, source_size, cap, w,
         CASE WHEN target >= cap THEN cap ELSE least(cap, (budget - full_sum) * w / open_w) END,
         budget - full_sum <= 0
  FROM (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
               coalesce(sum(CASE WHEN target >= cap THEN cap END) OVER (), 0) AS full_sum,
               sum(CASE WHEN target < cap THEN w END) OVER () AS open_w
        FROM rounds) WHERE k < (SELECT count(*) + 1 FROM sources)),
goals AS (SELECT source, source_size, target,
                 CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times
          FROM rounds WHERE k = (SELECT max(k) FROM rounds)),
cum AS (SELECT r, sum(size) OVER (PARTITION BY source ORDER BY h, r ROWS UNBOUNDED PRECEDING) - size / 2.0 AS mid FROM sized)
SELECT s.doc_id, s.size::BIGINT AS size, g.source_size, g.target,
       (s.size * (g.times + CASE WHEN c.mid <= g.target - g.times * g.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s
JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
JOIN cum c USING (r)
"""
