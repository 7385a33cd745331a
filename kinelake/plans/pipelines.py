"""Named compositions: what runs on a sample's way into a model and out of it."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.functions import pieces, texts, vectors
from kinelake.operators import aggregates, filters, project, windows
from kinelake.operators.project import Group, Transform, compose


def normalize(stats: dict[str, dict[str, Sequence[float]]], quantile: bool, *, inverse: bool = False) -> Transform:
    """Of the columns that have statistics. Inward, statistics without a column are ignored; outward they are an error."""
    if quantile and any(s.get("q01") is None or s.get("q99") is None for s in stats.values()):
        raise ValueError("normalising by quantiles needs q01 and q99 of every key")
    names = ("q01", "q99") if quantile else ("mean", "std")
    fn = {(False, False): vectors.normalize_z, (True, False): vectors.normalize_q, (False, True): vectors.unnormalize_z, (True, True): vectors.unnormalize_q}[quantile, inverse]

    def by_row(a, b):
        return lambda x: fn(x, a, b)

    def run(df: DataFrame) -> DataFrame:
        if inverse and (missing := [k for k in stats if k not in df.columns]):
            raise ValueError(f"statistics of {missing}, which the data lack")
        out = {}
        for key, s in stats.items():
            if key in df.columns:
                a, b = (vectors.doubles(s[n]) for n in names)
                nested = df.schema[key].dataType.simpleString().startswith("array<array")
                out[key] = F.transform(key, by_row(a, b)) if nested else fn(F.col(key), a, b)
        return df.withColumns(out) if out else df

    return run


def shift_actions(mask: Sequence[bool] | None, sign: int) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        if mask is None or "actions" not in df.columns:
            return df
        fn = vectors.delta_actions if sign < 0 else vectors.absolute_actions
        return df.withColumn("actions", fn(F.col("actions"), F.col("state"), mask))

    return run


def pad_to(dim: int) -> Transform:
    def run(df: DataFrame) -> DataFrame:
        out = {"state": vectors.pad(F.col("state"), dim)}
        if "actions" in df.columns:
            out["actions"] = F.transform("actions", lambda a: vectors.pad(a, dim))
        return df.withColumns(out)

    return run


def prompted(default: str | None) -> Transform:
    return (lambda df: project.default_prompt(df, default)) if default else (lambda df: df)


def model_inputs(model: str, dim: int, default: str | None = None) -> Transform:
    """``flow``: the cleaned prompt; ``flow_state``: with the digitised state, before padding; ``fast``: the same, lower-cased, without padding."""

    def text(df: DataFrame) -> DataFrame:
        p, s = F.col("prompt"), F.col("state")
        return df.withColumn("prompt_text", {"flow": texts.clean_prompt(p), "flow_state": texts.state_prompt(texts.clean_prompt(p), s, True), "fast": texts.state_prompt(texts.clean_prompt_lower(p), s, False)}[model])

    return compose(prompted(default), text, *([] if model == "fast" else [pad_to(dim)]))


@dataclass(frozen=True)
class DataConfig:
    """A dataset's way to a model: repack, robot's transforms, normalisation, model's transforms."""

    repack: Group = field(default_factory=Group)
    data: Group = field(default_factory=Group)
    model: Group = field(default_factory=Group)
    stats: dict = field(default_factory=dict)
    quantile: bool = False

    def training(self) -> Transform:
        return compose(*self.repack.inputs, *self.data.inputs, normalize(self.stats, self.quantile), *self.model.inputs)

    def inference_inputs(self, prompt: str | None = None) -> Transform:
        return compose(*self.repack.inputs, prompted(prompt), *self.data.inputs, normalize(self.stats, self.quantile), *self.model.inputs)

    def inference_outputs(self) -> Transform:
        return compose(*self.model.outputs, normalize(self.stats, self.quantile, inverse=True), *self.data.outputs, *self.repack.outputs)

    def for_stats(self) -> Transform:
        return compose(*self.repack.inputs, *self.data.inputs, project.remove_strings)


def delta_group(*dims: int) -> Group:
    """Deltas on the way in and their inverse on the way out."""
    mask = vectors.make_bool_mask(*dims)
    return Group().push(inputs=[shift_actions(mask, -1)], outputs=[shift_actions(mask, 1)])


#: Which dimensions of each robot's actions are deltas.
DELTA_DIMS = {"aloha": (6, -1, 6, -1), "libero": (6, -1), "droid_position": (7, -1), "droid_velocity": ()}


def robot_config(robot: str, model: str, stats: dict, *, extra_delta: bool = True, dim: int = 32, prompt: str | None = None) -> DataConfig:
    """The usual configuration of a robot; quantiles normalise for every model but ``flow``."""
    dims = DELTA_DIMS[robot]
    data = delta_group(*dims) if dims and (robot != "libero" or extra_delta) else Group()
    return DataConfig(data=data, model=Group(inputs=(model_inputs(model, dim, prompt),)), stats=stats, quantile=model != "flow")


def training_frames(frames: DataFrame, ranges: DataFrame | None, horizon: int, *, path: str | None = None) -> DataFrame:
    """Episodes to samples: success filter, look-ahead, then the range filter, which must not cut into chunks."""
    if path:
        frames = frames.filter(filters.successful(F.col(path)))
    return filters.in_ranges(windows.action_chunks(frames, horizon, out="actions"), ranges)


def compute_norm_stats(samples: DataFrame, keys: Sequence[str] = ("state", "actions")) -> DataFrame:
    return aggregates.norm_stats(aggregates.dimensions(samples, {k: F.col(k) for k in keys if k in samples.columns}))


def byte_tokens(text):
    """UTF-8 bytes as tokens: stands in where no tokenizer's file is at hand."""
    digits = F.hex(F.encode(text, "UTF-8"))
    one = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), one))


def library_tokenizer(spark: SparkSession, path: str) -> tuple[Callable, Callable]:
    """``encode`` and ``decode`` as Arrow-batched column functions, from a tokenizers or SentencePiece file on the driver.

    No special tokens are added. The file's bytes are broadcast, and each worker loads them once.
    """
    with open(path, "rb") as f:
        data = f.read()
    file = spark.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), path.endswith(".model"), data))

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        return _by_slices(texts, pieces.both_ways(*file.value)[0])

    @F.pandas_udf("string")
    def decode(tokens: pd.Series) -> pd.Series:
        return _by_slices(tokens, pieces.both_ways(*file.value)[1])

    return encode, decode


def _by_slices(values: pd.Series, fn: Callable[[list], list], size: int = 32) -> pd.Series:
    """``fn`` over few values at a time, as what a library makes of them is many times their size. Null stays null."""
    out = []
    for i in range(0, len(values), size):
        part = values.iloc[i : i + size].tolist()
        made = iter(fn([x for x in part if x is not None]))
        out += [None if x is None else next(made) for x in part]
    return pd.Series(out, dtype=object)


#: Tokenizers by name: a function from a text column to an array of tokens.
TOKENIZERS = {"bytes": byte_tokens}


def register_tokenizer(name: str, tokenize) -> None:
    """``tokenize`` may be any column function, such as a pandas UDF around a model's file."""
    TOKENIZERS[name] = tokenize
