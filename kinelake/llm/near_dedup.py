"""Near duplicates by b-bit MinHash.

1. Every document gives the set of its word shingles, as 64-bit hashes, and
   MINIMA minima over that set. ``BANDS`` bands of ``ROWS`` whole minima are
   hashed for candidate generation; of all minima only the low ``BITS`` bits
   are kept and packed. A 128-bit digest names the set itself.
2. Documents with the same set are one class; only its smallest id goes on.
3. Stars: in the first ``STAR_BANDS`` bands, each class looks at the smallest id
   of its bucket. Equal packed bits are counted, corrected for chance collisions,
   and the likeliest of these partners is confirmed on full sets: one text a
   class. This settles most buckets, a very large group of copies included.
4. The rest: of the buckets of all bands, those whose members aren't in one
   component yet are compared in blocks, by packed signatures alone. A pair
   counts in the first band that it shares, and only if its ends are in different
   components; the largest component of a bucket is never compared with itself.
   Only the members of pairs whose estimate is within ``SIGMAS`` deviations of
   the threshold fetch their texts, by smaller blocks, for confirmation.
5. The components of all links are the groups.

No bucket is capped and no pair of a group is emitted as a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import common
from kinelake.llm.components import components

MINIMA, BITS, BANDS, ROWS, SIGMAS = 128, 4, 24, 5, 4.5
#: Bands of the stars; signatures in a block; texts in a block, and their shingles.
STAR_BANDS, BLOCK_CLASSES, BLOCK_TEXTS, BLOCK_SHINGLES = 8, 1024, 256, 1_000_000

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_FACTORS = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted hashes of the distinct ``k``-word shingles; of a shorter text, of all its words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = common.word_hashes(words)
    k = min(k, len(h))
    return np.unique(common.gram_hashes(h, k, 0x9E3779B97F4A7C15 + 2 * k))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function, over chunks so that memory is bounded."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (_FACTORS[:, None] * shingles[None, i : i + 2048]).min(1), out=low)
    return common.mix64(low)


def pack(low: np.ndarray) -> np.ndarray:
    """The low ``BITS`` (4) bits of each minimum, sixteen to a word."""
    bits = (low & np.uint64(2**BITS - 1)).reshape(-1, 16) << np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=1)


def band_keys(low: np.ndarray) -> np.ndarray:
    """A hash of the whole minima of each band."""
    rows = (low[: BANDS * ROWS].reshape(BANDS, ROWS) * _BAND_FACTORS).sum(1, dtype=np.uint64)
    return common.mix64(rows + np.arange(BANDS, dtype=np.uint64))


def equal_minima(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many minima the low bits are equal, rows of ``a`` by rows of ``b``."""
    same = np.zeros((len(a), len(b)), np.uint16)
    low = np.uint64(0x1111111111111111)
    for i in range(a.shape[1]):  # of each word, count the nibbles in which no bit differs
        x = a[:, None, i] ^ b[None, :, i]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        same += np.bitwise_count(~x & low)
    return same


def equal_minima_column(a: str, b: str) -> Column:
    """The same of two columns of packed words."""
    total = F.lit(0)
    for i in range(MINIMA * BITS // 64):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        total = total + F.lit(16) - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def estimate(same):
    """The similarity that a number of equal minima stands for, without the collisions that chance makes."""
    chance = 2.0**-BITS
    return (same / MINIMA - chance) / (1 - chance)


def least_equal(threshold: float) -> int:
    """Equal minima from which the estimate is within ``SIGMAS`` deviations of the threshold."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * threshold
    return math.ceil(MINIMA * p - SIGMAS * (MINIMA * p * (1 - p)) ** 0.5)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, bands, packed = [], [], [], [], []
            for text in common.each(batch.column(1)):
                s = shingle_set(text, k)
                n.append(len(s))
                digest = xxhash.xxh3_128_digest(s.tobytes())
                a.append(int.from_bytes(digest[:8], "little", signed=True))
                b.append(int.from_bytes(digest[8:], "little", signed=True))
                if len(s):
                    low = minima(s)
                    bands.append(band_keys(low).view(np.int64))
                    packed.append(pack(low).view(np.int64))
                else:
                    bands.append([])
                    packed.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", "packed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>, packed array<bigint>")


class Forest:
    """Which members of a block are connected."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def star_links(docs: DataFrame, classes: DataFrame, k: int, percent: int, large: int) -> DataFrame:
    """``a, b``: links of classes ``b`` with the smallest id ``a`` of a bucket; one text for each ``b``."""
    bands = classes.select("doc_id", F.explode(F.slice("bands", 1, STAR_BANDS)).alias("band"))
    first = common.staged(bands.groupBy("band").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).filter("n > 1"), "stars")
    hot = F.col("n") >= large  # STAR_BANDS thousand at most, as every band has each class once
    pairs = common.join_hot(bands, first, ["band"], hot).filter("a != doc_id").select("a", F.col("doc_id").alias("b"), hot.alias("hot")).groupBy("a", "b").agg(F.max("hot").alias("hot"))
    pairs = common.staged(pairs, "star-pairs")

    signed = classes.select("doc_id", "n_shingles", "packed")
    hubs = pairs.groupBy("a").agg(F.max("hot").alias("hub"))
    mine = pairs.select("a", "b").join(signed.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("packed").alias("pb")), "b")
    theirs = common.staged(signed.join(hubs.withColumnRenamed("a", "doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("packed").alias("pa"), "hub"), "hubs")
    both = common.join_hot(mine, theirs, ["a"], F.col("hub"))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    likely = both.filter(sizes).withColumn("same", equal_minima_column("pa", "pb")).filter(F.col("same") >= least_equal(percent / 100))
    best = common.staged(likely.groupBy("b").agg(F.max(F.struct("same", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"), "best")

    # A hub of very many is cut into parts, each with the hub's text before the others.
    parts = F.broadcast(best.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") >= large).select("a", F.ceil(F.col("n") / large).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")
    others = best.join(parts, "a", "left").select("a", part.alias("part"), F.lit(1).alias("side"), F.col("b").alias("doc_id"))
    rows = common.staged(others.unionByName(others.select("a", "part", F.lit(0).alias("side"), F.col("a").alias("doc_id")).distinct()), "star-rows")
    wanted = common.only(docs, common.staged(rows.select("doc_id").distinct(), "wanted"), "doc_id")
    ready = rows.join(wanted, "doc_id").repartition("a", "part").sortWithinPartitions("a", "part", "side").select("a", "part", "side", "doc_id", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for batch in batches:
            found = []
            for row, (a, part, side, text) in enumerate(zip(*(common.each(batch.column(i)) for i in (0, 1, 2, 4)), strict=True)):
                if side == 0:
                    if at != (a, part):
                        at, hubs = (a, part), []
                    hubs.append(shingle_set(text, k))
                elif any(linked(hub, own, percent) for own in [shingle_set(text, k)] for hub in hubs):
                    found.append(row)
            keep = batch.take(pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(3)], ["a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ready.mapInArrow(confirm, f"a {kind}, b {kind}")


def candidates(side, comp, size, words, bands, number, least: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal minima and both ends of the pairs of a block that may be links.

    Ends are of different components, of different sides if there are two, and
    share no band before band ``number``.
    """
    found: list[tuple] = [(np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0, np.int64))]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    crossed = len(right) > 0
    right = right if crossed else left
    for i in range(0, len(left), 128):
        r = left[i : i + 128]
        c = right if crossed else right[i + 1 :]
        same = equal_minima(words[r], words[c])
        ok = (same >= least) & (comp[r][:, None] != comp[c][None])
        ok &= 100 * np.minimum(size[r][:, None], size[c][None]) >= percent * np.maximum(size[r][:, None], size[c][None])
        if not crossed:
            ok &= c[None] > r[:, None]
        x, y = np.nonzero(ok)
        if len(x):
            new = ~(bands[r[x], :number] == bands[c[y], :number]).any(1)
            x, y = x[new], y[new]
            found.append((same[x, y], r[x], c[y]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, -1)


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    """What ``candidates`` takes."""
    one = lambda name: table.column(name).combine_chunks().to_numpy(zero_copy_only=False)
    of = lambda name: _matrix(pa.concat_arrays(table.column(name).chunks), table.num_rows)
    return {"side": one("side"), "comp": one("comp"), "size": one("n_shingles"), "words": of("packed"), "bands": of("bands"), "number": int(one("number")[0])}


def open_blocks(classes: DataFrame, large: int) -> DataFrame:
    """Blocks of the buckets that hold several components: ``band, i, j, side, number, comp`` and the class's own columns.

    Components are told apart by 64-bit hashes, whatever ids are.
    """
    classes = classes.withColumn("comp", F.xxhash64("comp"))
    bands = classes.select("doc_id", "comp", F.posexplode("bands").alias("number", "band"))
    several = common.staged(bands.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo != hi").select("band", "n"), "open")
    members = common.staged(common.join_hot(bands, several, ["band"], F.col("n") >= large), "unsettled")

    # The largest component of a bucket isn't compared with itself, only with the rest.
    sizes = members.groupBy("band", "n", "comp").agg(F.count("*").alias("c")).groupBy("band", "n").agg(F.max(F.struct("c", "comp")).alias("m"))
    count = lambda c: F.ceil(c / BLOCK_CLASSES).cast("int")
    sizes = common.staged(sizes.select("band", F.col("m.comp").alias("main"), F.col("n").alias("all"), F.when(F.col("n") > BLOCK_CLASSES, count(F.col("m.c"))).otherwise(0).alias("mains"), count(F.when(F.col("n") > BLOCK_CLASSES, F.col("n") - F.col("m.c")).otherwise(1)).alias("rests")), "sizes")
    placed = common.join_hot(members.drop("n"), sizes, ["band"], F.col("all") >= large)
    is_main = (F.col("mains") > 0) & (F.col("comp") == F.col("main"))
    own = F.pmod(F.xxhash64("doc_id", "number"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    # Blocks (i, j): of the rest with itself if i <= j, of the rest's i with the main one's if j < 0.
    within = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda x: F.struct(F.least(x, "own").alias("i"), F.greatest(x, "own").alias("j"), (x < F.col("own")).cast("int").alias("side")))
    across = F.when(F.col("mains") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("mains") - 1, F.lit(0))), lambda x: F.struct(F.col("own").alias("i"), (-x - 1).alias("j"), F.lit(0).alias("side")))).otherwise(F.array())
    mains = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda x: F.struct(x.alias("i"), (-F.col("own") - 1).alias("j"), F.lit(1).alias("side")))
    blocks = placed.withColumn("own", own).select("band", "number", "doc_id", F.explode(F.when(is_main, mains).otherwise(F.concat(within, across))).alias("at"))
    signed = classes.select("doc_id", "comp", "n_shingles", "packed", "bands")
    return blocks.join(signed, "doc_id").select("band", "at.i", "at.j", "at.side", "number", "comp", "n_shingles", "packed", "bands", "doc_id")


def block_links(docs: DataFrame, classes: DataFrame, k: int, percent: int, large: int) -> DataFrame:
    """``a, b``: enough links between the components ``comp`` of ``classes`` to connect all that are linked."""
    least, kind = least_equal(percent / 100), docs.schema["doc_id"].dataType.simpleString()
    blocks = open_blocks(classes, large).repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    texts, shingles = BLOCK_TEXTS, BLOCK_SHINGLES

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of likely pairs, by smaller blocks ``u, v`` within the block."""
        for table in common.runs_of_keys(batches, 3):
            if table.num_rows < 2:
                continue
            own = _columns(table)
            _, x, y = candidates(**own, least=least, percent=percent)
            if not len(x):
                continue
            hit = np.zeros(table.num_rows, bool)
            hit[x] = hit[y] = True
            load = np.maximum(np.cumsum(hit) - 1, 0) // texts + np.cumsum(own["size"] * hit) // shingles
            new = np.r_[True, load[1:] != load[:-1]]
            part = np.cumsum(new) - 1
            u, v = np.minimum(part[x], part[y]), np.maximum(part[x], part[y])
            rows = np.unique(np.r_[np.stack([u, v, x], 1), np.stack([u, v, y], 1)], axis=0)
            taken = table.take(pa.array(rows[:, 2]))
            extra = [pa.array(rows[:, 0].astype(np.int32)), pa.array(rows[:, 1].astype(np.int32))]
            taken = pa.table([*taken.columns[:3], *extra, *taken.columns[3:]], ["band", "i", "j", "u", "v", *table.column_names[3:]])
            yield from taken.combine_chunks().to_batches(max_chunksize=4096)

    fields = f"side int, number int, comp bigint, n_shingles bigint, packed array<bigint>, bands array<bigint>, doc_id {kind}"
    likely = common.staged(blocks.mapInArrow(narrowed, f"band bigint, i int, j int, u int, v int, {fields}"), "likely")
    wanted = common.only(docs, common.staged(likely.select("doc_id").distinct(), "wanted"), "doc_id")
    key = ["band", "i", "j", "u", "v"]
    ready = likely.join(wanted, "doc_id").repartition(*key).sortWithinPartitions(*key).select(*key, "side", "number", "comp", "n_shingles", "packed", "bands", "doc_id", "text")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.runs_of_keys(batches, 5):
            same, x, y = candidates(**_columns(table), least=least, percent=percent)
            found_a, found_b, forest, sets, all_texts = [], [], Forest(table.num_rows), {}, table.column("text")
            for r in np.argsort(-same.astype(np.int64), kind="stable").tolist():
                a, b = int(x[r]), int(y[r])
                if forest.root(a) == forest.root(b):
                    continue
                for z in (a, b):
                    if z not in sets:
                        sets[z] = shingle_set(all_texts[z].as_py(), k)
                if linked(sets[a], sets[b], percent):
                    forest.join(a, b)
                    found_a.append(a)
                    found_b.append(b)
            ids = table.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(found_a, pa.int64())), ids.take(pa.array(found_b, pa.int64()))], ["a", "b"])

    return ready.mapInArrow(confirm, f"a {kind}, b {kind}")


def linked_groups(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """``v, label`` of the classes that are linked with any other."""
    large = common.large_enough(classes.count())
    near = components(common.staged(star_links(docs, classes, k, percent, large), "star-links"))
    own = classes.join(near, classes["doc_id"] == near["v"], "left").select(*classes.columns, F.coalesce("label", "doc_id").alias("comp"))
    own = common.staged(own, "star-components")
    links = common.staged(block_links(docs, own, k, percent, large), "block-links")
    if links.isEmpty():
        return near
    # The stars' components are the vertices of what is left.
    of = own.select("doc_id", "comp")
    ends = links.join(of.select(F.col("doc_id").alias("a"), F.col("comp").alias("x")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("comp").alias("y")), "b")
    joined = components(ends.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return of.join(joined, of["comp"] == joined["v"], "left").select(F.col("doc_id").alias("v"), F.coalesce("label", "comp").alias("label"))


def near_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 85) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their
    sets of ``k``-word shingles (A-Z lower-cased); ``component_id`` is the
    smallest id reachable. Null, empty and blank texts have no shingles and are
    linked with nothing, as are rows without an id; a text of fewer than ``k``
    words is one shingle. Rows that repeat an id are one document, which is linked
    as any of its texts is; all are kept or dropped alike. An empty table gives no rows; other columns are not read.
    """
    docs = common.documents(df, id_col, text_col)
    signed = common.staged(signatures(docs, k), "signatures")
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    of_set = signed.filter(linkable).groupBy("set_a", "set_b")
    classes = common.staged(of_set.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "packed"))), "classes")
    groups = linked_groups(docs, classes.select("doc_id", "n_shingles", "bands", "packed"), k, percent)
    named = classes.join(groups.distinct(), classes["doc_id"] == groups["v"], "left").select("set_a", "set_b", "n", F.coalesce("label", "doc_id").alias("component_id"))

    # Sets shared by over a thousandth of all rows (a thousand at most) are broadcast; the others meet by key.
    named = common.staged(named, "named")
    ids = signed.select("doc_id", "n_shingles", "set_a", "set_b")
    found = common.join_hot(ids.filter(linkable), named, ["set_a", "set_b"], F.col("n") >= common.large_enough(signed.count())).select("doc_id", "n_shingles", "component_id")
    none = ids.filter(~linkable).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(common.read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS s FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other),
components AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = doc_id AS kept FROM components LEFT JOIN sizes USING (doc_id)
"""
