"""Nested records: repacking, renaming, flattening.

Names are resolved on the driver against the schema; the data see one select.
A record's keys are the paths of its leaves, joined by ``/``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Transform = Callable[[DataFrame], DataFrame]


def leaves(schema: T.StructType, prefix: tuple[str, ...] = ()) -> dict[str, Column]:
    """Path to column of every leaf; structs are walked, arrays and maps are leaves."""
    found: dict[str, Column] = {}
    for f in schema.fields:
        path = (*prefix, f.name)
        if isinstance(f.dataType, T.StructType):
            found |= leaves(f.dataType, path)
        else:
            found["/".join(path)] = F.col(".".join(f"`{p}`" for p in path))
    return found


def nest(columns: Mapping[str, Column]) -> list[Column]:
    """Columns of a flat mapping as nested structs."""
    tree: dict = {}
    for path, c in columns.items():
        *above, name = path.split("/")
        at = tree
        for p in above:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise ValueError(f"'{p}' is both a value and a group")
        if name in at:
            raise ValueError(f"two values for '{path}'")
        at[name] = c

    def built(node: dict) -> list[Column]:
        return [(F.struct(*built(v)) if isinstance(v, dict) else v).alias(k) for k, v in node.items()]

    return built(tree)


def flatten(df: DataFrame) -> DataFrame:
    return df.select(*(c.alias(p) for p, c in leaves(df.schema).items()))


def unflatten(df: DataFrame) -> DataFrame:
    return df.select(*nest({c: F.col(f"`{c}`") for c in df.columns}))


def repack(df: DataFrame, structure: Mapping) -> DataFrame:
    """``structure``: a tree whose leaves are source paths. Whatever it doesn't name is dropped."""
    own = leaves(df.schema)

    def walk(node: Mapping, prefix: str = "") -> dict[str, Column]:
        found = {}
        for k, v in node.items():
            if isinstance(v, Mapping):
                found |= walk(v, f"{prefix}{k}/")
            elif v not in own:
                raise KeyError(f"{v} (there are: {', '.join(own)})")
            else:
                found[f"{prefix}{k}"] = own[v]
        return found

    return df.select(*nest(walk(structure)))


def rename(df: DataFrame, patterns: Mapping[str, str | None]) -> DataFrame:
    """Paths that a pattern matches whole are renamed (once, with back references) or dropped (None); the first pattern counts."""
    out: dict[str, Column] = {}
    for path, c in leaves(df.schema).items():
        target: str | None = path
        for pattern, to in patterns.items():
            if re.fullmatch(pattern, path):
                target = None if to is None else re.sub(pattern, to, path, count=1)
                break
        if target is None:
            continue
        if target in out:
            raise ValueError(f"two values for '{target}'")
        out[target] = c
    for a in out:
        if any(b.startswith(f"{a}/") for b in out):
            raise ValueError(f"'{a}' is both a value and a group")
    return df.select(*nest(out))


def apply_to(df: DataFrame, selected: Mapping[str, object], fn: Callable[[Column, object], Column], strict: bool = False) -> DataFrame:
    """``fn(column, selected[path])`` on each leaf that ``selected`` names; ``strict``: all of these must be there."""
    own = leaves(df.schema)
    if strict and (missing := [k for k in selected if k not in own]):
        raise ValueError(f"nothing to apply to at {missing}")
    return df.select(*nest({p: fn(c, selected[p]) if p in selected else c for p, c in own.items()}))


def default_prompt(df: DataFrame, prompt: str) -> DataFrame:
    """A prompt where the column is absent; a null prompt stays null."""
    return df if "prompt" in df.columns else df.withColumn("prompt", F.lit(prompt))


def remove_strings(df: DataFrame) -> DataFrame:
    return df.select(*(f.name for f in df.schema.fields if not isinstance(f.dataType, T.StringType)))


def compose(*transforms: Transform) -> Transform:
    """Left to right."""

    def run(df: DataFrame) -> DataFrame:
        for t in transforms:
            df = df.transform(t)
        return df

    return run


@dataclass(frozen=True)
class Group:
    """Transforms on the way in, and on the way out, where the last pushed comes first."""

    inputs: Sequence[Transform] = field(default=())
    outputs: Sequence[Transform] = field(default=())

    def push(self, *, inputs: Sequence[Transform] = (), outputs: Sequence[Transform] = ()) -> Group:
        return Group((*self.inputs, *inputs), (*outputs, *self.outputs))


def joined(*parts: Column) -> Column:
    """Vectors and single numbers, one after the other."""
    return F.concat(*parts)


#: Image slots by model type, and which of them have a true mask.
DROID_SLOTS = {"flow": (("base_0_rgb", True), ("left_wrist_0_rgb", True), ("right_wrist_0_rgb", False)), "fast": (("base_0_rgb", True), ("base_1_rgb", True), ("wrist_0_rgb", True))}


def droid_masks(model: str) -> Column:
    """``map<slot, mask>``; the slot that has no camera is masked off, except for the fast model."""
    return F.create_map(*(x for slot, on in DROID_SLOTS["fast" if model == "fast" else "flow"] for x in (F.lit(slot), F.lit(on))))


def libero_masks(model: str) -> Column:
    return F.create_map(F.lit("base_0_rgb"), F.lit(True), F.lit("left_wrist_0_rgb"), F.lit(True), F.lit("right_wrist_0_rgb"), F.lit(model == "fast"))


#: Cameras of the two-arm robot; the first is required.
ALOHA_CAMERAS = ("cam_high", "cam_low", "cam_left_wrist", "cam_right_wrist")


def aloha_masks(images: Column) -> Column:
    """Which of the optional cameras a map of images has; unknown cameras and a missing base are errors."""
    names = F.map_keys(images)
    extra = F.array_except(names, F.array(*map(F.lit, ALOHA_CAMERAS)))
    found = F.create_map(*(x for c in ALOHA_CAMERAS for x in (F.lit(c), F.array_contains(names, c))))
    return F.when((F.size(extra) > 0) | ~F.array_contains(names, ALOHA_CAMERAS[0]), F.raise_error(F.lit("unexpected or missing cameras"))).otherwise(found)


def pick_per_episode(episode: Column, seed: int, k: int) -> Column:
    """One of ``k`` for a whole episode: a function of its key and the seed, the same in any engine."""
    h = F.conv(F.substring(F.md5(F.concat(episode.cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(k))


def spread(vector: Column, names: Sequence[tuple[str, int]]) -> list[Column]:
    """A vector as named columns: (prefix, width) pairs."""
    flat = [f"{p}_{i}" for p, n in names for i in range(n)]
    return [vector[i].alias(name) for i, name in enumerate(flat)]


def assert_schema(df: DataFrame, expected: T.StructType, *, nullability: bool = False) -> DataFrame:
    """``df`` if its columns and types are as expected, with what differs in the error."""
    plain = lambda s: [(f.name, f.dataType, *([f.nullable] if nullability else [])) for f in s.fields]
    if plain(df.schema) != plain(expected):
        raise ValueError(f"expected {expected.simpleString()}, got {df.schema.simpleString()}")
    return df


def checked_length(x: Column, n: int, what: str = "vector") -> Column:
    return F.when(F.size(x) == n, x).otherwise(F.raise_error(F.concat(F.lit(f"{what}: expected {n} values, got "), F.size(x).cast("string"))))
