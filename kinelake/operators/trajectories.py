"""Functions of whole episodes, for what no column expression can say."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def pieces(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, pa.RecordBatch]]:
    """Batches cut where the key changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key))
        # Where a value isn't that of the row before; two nulls are the same.
        a, b = k.slice(1), k.slice(0, len(k) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        cuts = [0, *(pc.add(pc.indices_nonzero(pc.invert(same)), 1).to_pylist()), len(k)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield k[i].as_py(), batch.slice(i, j - i)


def trajectory_map(frames: DataFrame, fn: Callable[[object, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType, *, episode: str = "episode", t: str = "t") -> DataFrame:
    """``fn(episode, batches)`` of each episode, whose frames come in the order of ``t`` as a stream of Arrow batches.

    Neither ``fn`` nor Spark needs an episode in memory: it is shuffled once by
    its key, sorted on disk where it is long, and read a batch at a time; ``fn``
    gives batches of ``schema`` (by place) as it goes, and may stop early. Null is
    an episode like others; an episode stays in one task, as its function is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in groupby(pieces(batches, episode), key=lambda p: p[0]):
            yield from fn(key, (piece for _, piece in own))

    return frames.repartition(F.col(episode)).sortWithinPartitions(episode, t).mapInArrow(run, schema)


def chunker(horizon: int, action: str, keys: tuple[str, ...] = ("episode", "t")) -> Callable[[object, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """An episode function that gives each frame's next ``horizon`` actions, the last one repeated past the end.

    It holds a batch and ``horizon`` frames.
    """

    def run(_: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def chunks(table: pa.Table, n: int) -> Iterator[pa.RecordBatch]:
            """Of the first ``n`` rows; where those after them run out, the last row stands in."""
            actions = table.column(action).combine_chunks()
            at = pa.array([min(i + k, len(actions) - 1) for i in range(n) for k in range(horizon)], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(range(0, n * horizon + 1, horizon), pa.int32()), actions.take(at))
            yield from pa.Table.from_arrays([*(table.column(k).slice(0, n) for k in keys), lists], [*keys, "chunk"]).combine_chunks().to_batches()

        for batch in batches:
            new = pa.Table.from_batches([batch]).select([*keys, *({action} - set(keys))])
            held = new if held is None else pa.concat_tables([held, new])
            if (ready := held.num_rows - horizon + 1) > 0:
                yield from chunks(held, ready)
                held = held.slice(ready)
        if held is not None and held.num_rows:
            yield from chunks(held, held.num_rows)

    return run
