"""Vector math as column expressions: arrays of doubles in, arrays or numbers out.

Nothing here runs Python on the executors; every function builds one expression.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6

# Fixed values of the two-arm robot's conventions: signs of its 14 joints, and its grippers' ranges.
JOINT_SIGNS = (1, -1, -1, 1, 1, 1, 1, 1, -1, -1, 1, 1, 1, 1)
PUPPET_POSITION = (0.01844, 0.05800)
PUPPET_JOINT = (-0.6213, 1.4910)
MASTER_POSITION = (0.01244, 0.02417)
MASTER_JOINT = (-0.6842, 0.3083)
ANGLE = (0.5476, 1.6296)
ARM, HORN = 0.036, 0.022


def doubles(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / (F.greatest(norm(x), F.lit(EPS)) * F.greatest(norm(y), F.lit(EPS)))


# Normalisation. Statistics may be longer than the vector (normalise) or shorter (unnormalise).


def fit_length(stats: Column, x: Column, fill: float) -> Column:
    """``stats`` cut or filled to the length of ``x``."""
    return F.slice(pad(stats, F.size(x), fill), F.lit(1), F.size(x))


def normalize_z(x: Column, mean: Column, std: Column) -> Column:
    centred = F.zip_with(x, F.slice(mean, F.lit(1), F.size(x)), lambda v, m: v - m)
    return F.zip_with(centred, F.slice(std, F.lit(1), F.size(x)), lambda v, s: v / (s + EPS))


def normalize_q(x: Column, q01: Column, q99: Column) -> Column:
    span = F.zip_with(q01, q99, lambda a, b: b - a + EPS)
    low = F.zip_with(x, F.slice(q01, F.lit(1), F.size(x)), lambda v, a: v - a)
    return F.zip_with(low, F.slice(span, F.lit(1), F.size(x)), lambda v, s: v / s * 2.0 - 1.0)


def unnormalize_z(x: Column, mean: Column, std: Column) -> Column:
    """Dimensions beyond the statistics have mean 0 and deviation 1."""
    scaled = F.zip_with(x, fit_length(std, x, 1.0), lambda v, s: v * (s + EPS))
    return F.zip_with(scaled, fit_length(mean, x, 0.0), lambda v, m: v + m)


def unnormalize_q(x: Column, q01: Column, q99: Column) -> Column:
    """Dimensions beyond the statistics pass unchanged; a vector that is shorter than them is an error."""
    low, span = q01, F.zip_with(q01, q99, lambda a, b: b - a + EPS)
    known = F.zip_with(F.zip_with(F.slice(x, F.lit(1), F.size(span)), span, lambda v, s: (v + 1.0) / 2.0 * s), low, lambda v, a: v + a)
    rest = F.slice(x, F.size(span) + 1, F.greatest(F.size(x) - F.size(span), F.lit(0)))
    return F.when(F.size(x) < F.size(span), F.raise_error(F.lit("the vector is shorter than its statistics"))).otherwise(F.concat(known, rest))


# Actions.


def make_bool_mask(*dims: int) -> list[bool]:
    """``n`` trues for a positive number, as many falses for a negative one."""
    return [n > 0 for n in dims for _ in range(abs(n))]


def _shift(actions: Column, state: Column, mask: Sequence[bool] | None, sign: int) -> Column:
    if mask is None:
        return actions
    masked = F.zip_with(F.slice(state, 1, len(mask)), F.array(*map(F.lit, mask)), lambda s, m: F.when(m, s * sign).otherwise(F.lit(0.0)))
    return F.transform(actions, lambda row: F.zip_with(row, pad(masked, F.size(row), 0.0), lambda a, s: a + s))


def delta_actions(actions: Column, state: Column, mask: Sequence[bool] | None) -> Column:
    """Each row of ``actions`` relative to the state, in the first dimensions that ``mask`` names."""
    return _shift(actions, state, mask, -1)


def absolute_actions(actions: Column, state: Column, mask: Sequence[bool] | None) -> Column:
    return _shift(actions, state, mask, 1)


def pad(x: Column, n: Column | int, value: float = 0.0) -> Column:
    """Filled at the right to ``n`` values; a longer vector is left as it is."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(n - F.size(x), F.lit(0))))


def first_dims(actions: Column, n: int) -> Column:
    return F.transform(actions, lambda a: F.slice(a, 1, n))


def every(x: Column, stride: int) -> Column:
    return F.filter(x, lambda _, i: i % stride == 0)


# Robot conventions.


def normalize(v: Column, low: float, high: float) -> Column:
    return (v - low) / (high - low)


def unnormalize(v: Column, low: float, high: float) -> Column:
    return v * (high - low) + low


def flip_joints(x: Column) -> Column:
    return F.zip_with(x, doubles(JOINT_SIGNS), lambda a, s: a * s)


def gripper_to_angular(v: Column) -> Column:
    """A gripper's normalised opening as a normalised angle, by the law of cosines of its crank."""
    p = unnormalize(v, *PUPPET_POSITION)
    sine = (HORN**2 + p * p - ARM**2) / (2 * HORN * p)
    return normalize(F.asin(F.greatest(F.least(sine, F.lit(1.0)), F.lit(-1.0))), *ANGLE)


def gripper_from_angular(v: Column) -> Column:
    return normalize(v + ANGLE[0], *PUPPET_JOINT)


def gripper_from_angular_inv(v: Column) -> Column:
    return unnormalize(v, *PUPPET_JOINT) - ANGLE[0]


def master_to_puppet_position(v: Column) -> Column:
    return unnormalize(normalize(v, *MASTER_POSITION), *PUPPET_POSITION)


def master_to_puppet_joint(v: Column) -> Column:
    return unnormalize(normalize(v, *MASTER_JOINT), *PUPPET_JOINT)


def puppet_position_to_joint(v: Column) -> Column:
    return unnormalize(normalize(v, *PUPPET_POSITION), *PUPPET_JOINT)


def puppet_joint_to_position(v: Column) -> Column:
    return unnormalize(normalize(v, *PUPPET_JOINT), *PUPPET_POSITION)


def puppet_velocity(v: Column) -> Column:
    return v / (PUPPET_POSITION[1] - PUPPET_POSITION[0])


def quat_to_axis_angle(q: Column) -> Column:
    """(x, y, z, w) to axis times angle; zero where there is no rotation."""
    w = F.greatest(F.least(q[3], F.lit(1.0)), F.lit(-1.0))
    den = F.sqrt(1.0 - w * w)
    return F.transform(F.slice(q, 1, 3), lambda v: F.when(den == 0, F.lit(0.0)).otherwise(v * 2.0 * F.acos(w) / den))


def binarize_gripper(action: Column) -> Column:
    """The last dimension to 0 or 1 (above a half), all clipped to [-1, 1]."""
    n = F.size(action)
    return F.transform(action, lambda v, i: F.when(i == n - 1, (v > 0.5).cast("double")).otherwise(F.greatest(F.least(v, F.lit(1.0)), F.lit(-1.0))))


def interpolate(a: Column, b: Column, n: int) -> Column:
    """``n`` evenly spaced values from ``a`` to ``b``, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: a + (b - a) * i / max(1, n - 1))


def put_along(x: Column, indices: Column, values: Column) -> Column:
    """``x`` with values at indices; values of one index add up."""
    pairs = F.arrays_zip(indices.alias("i"), values.alias("v"))
    return F.transform(x, lambda old, k: F.when(F.array_contains(indices, k), total(F.transform(F.filter(pairs, lambda p: p["i"] == k), lambda p: p["v"]))).otherwise(old))


def match_magnitude(x: Column, mode: str, constant: float = 1.0, truth: Column | None = None) -> Column:
    n = F.greatest(norm(x), F.lit(EPS))
    if mode == "none" or (mode == "gt" and truth is None):
        return x
    if mode == "constant":
        return F.transform(x, lambda v: v / n * constant)
    if mode == "gt":
        t = F.greatest(norm(truth), F.lit(EPS))
        return F.transform(x, lambda v: v / n * t)
    raise ValueError(f"Unknown mode: {mode!r}")


def logsumexp(x: Column) -> Column:
    top = F.array_max(x)
    return top + F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def info_nce(positive: Column, every_logit: Column) -> Column:
    """Minus the log of the positives' share, from logits."""
    return logsumexp(every_logit) - logsumexp(positive)


# Embeddings of positions: sines, then cosines.


def sincos(position: Column, frequencies: Sequence[float]) -> Column:
    f = doubles(frequencies)
    return F.concat(F.transform(f, lambda w: F.sin(position * w)), F.transform(f, lambda w: F.cos(position * w)))


def temporal_embedding(position: Column, dim: int) -> Column:
    """Also of signed time differences."""
    half = dim // 2
    return sincos(position, [math.exp(-math.log(10000.0) / half * i) for i in range(half)])


def position_embedding(position: Column, dim: int, omega: float = 100.0) -> Column:
    half = dim // 2
    return sincos(position, [omega ** (-i / half) for i in range(half)])


def period_embedding(position: Column, dim: int, least: float, most: float) -> Column:
    half = dim // 2
    return sincos(position, [2 * math.pi / (least * (most / least) ** (i / max(1, half - 1))) for i in range(half)])


def grid_coordinates(width: int, height: int, aspect: float = 1.0) -> list[tuple[int, int, float, float]]:
    """(row, column, u, v) of a grid whose half diagonal is one."""
    diagonal = math.hypot(aspect, 1.0)
    u, v = aspect / diagonal * (width - 1) / width, 1.0 / diagonal * (height - 1) / height
    at = lambda m, i, n: -m + 2 * m * i / max(1, n - 1)
    return [(r, c, at(u, c, width), at(v, r, height)) for r in range(height) for c in range(width)]


def square_grid(n: int) -> tuple[int, int]:
    """(cameras, side): the largest square that divides ``n``."""
    side = next(s for s in range(math.isqrt(n), 0, -1) if n % (s * s) == 0) if n else 0
    return (n // (side * side) if side else 0), side


# Finite scalar quantisation.

#: Bins a dimension for each codebook size.
FSQ_BINS = {2**8: (8, 6, 5), 2**10: (8, 5, 5, 5), 2**12: (7, 5, 5, 5, 5), 2**14: (8, 8, 8, 6, 5), 2**16: (8, 8, 8, 5, 5, 5)}


def places(bins: Sequence[int]) -> list[int]:
    return [math.prod(bins[:i]) for i in range(len(bins))]


def fsq_encode(z: Column, bins: Sequence[int]) -> Column:
    """The token of a vector in [-1, 1]; digits round half to even."""
    digits = F.zip_with(z, F.array(*map(F.lit, bins)), lambda v, b: F.rint((v + 1.0) * (b - 1) / 2.0).cast("long"))
    return F.aggregate(F.zip_with(digits, F.array(*map(F.lit, places(bins))), lambda d, p: d * p), F.lit(0).cast("long"), lambda a, v: a + v)


def fsq_decode(token: Column, bins: Sequence[int]) -> Column:
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(b).alias("b")) for p, b in zip(places(bins), bins, strict=True)))
    return F.transform(pairs, lambda x: F.pmod(F.floor(token / x["p"]), x["b"]) / (x["b"] - 1) * 2.0 - 1.0)


# Schedules and colours.


def warmup_cosine(step: Column, warmup: int, peak: float, decay: int, end: float) -> Column:
    start = peak / (warmup + 1)
    progress = F.least(F.lit(1.0), (step - warmup) / float(max(1, decay - warmup)))
    return F.when(step < warmup, start + (peak - start) * step / float(warmup)).otherwise(end + (peak - end) * 0.5 * (1 + F.cos(math.pi * progress)))


def warmup_rsqrt(step: Column, warmup: int, peak: float, timescale: float) -> Column:
    start = peak / (warmup + 1)
    return F.when(step < warmup, start + (peak - start) * step / float(warmup)).otherwise(peak / F.sqrt((timescale + step - warmup) / timescale))


def jet(v: Column) -> Column:
    """Red, green and blue bytes of a value in [0, 1]; fractions are cut off."""
    clip = lambda x: F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))
    return F.array(*(F.floor(clip(1.5 - F.abs(4.0 * clip(v) - k)) * 255.0).cast("long") for k in (3.0, 2.0, 1.0)))


def blend(image: Column, colour: Column, alpha: float) -> Column:
    return F.floor(F.greatest(F.least(image * (1.0 - alpha) + colour * alpha, F.lit(255.0)), F.lit(0.0))).cast("long")
