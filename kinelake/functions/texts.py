"""Text, token and image-geometry functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens at the end of a vocabulary that actions don't use, and bins of a state.
SKIPPED_TOKENS, STATE_BINS = 128, 256


def strip(s: Column) -> Column:
    """Without white space at the ends, of any kind."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def clean_prompt(s: Column) -> Column:
    """Stripped; underscores and line ends become spaces; case is kept."""
    return F.translate(strip(s), "_\n", "  ")


def clean_prompt_lower(s: Column) -> Column:
    """Lower-cased and stripped; underscores become spaces; line ends are kept."""
    return F.translate(strip(F.lower(s)), "_", " ")


def digitize(x: Column) -> Column:
    """The bin of a state value: -1 below -1, 255 from 127/128 on and for NaN."""
    return F.when(F.isnan(x), F.lit(255)).otherwise(F.greatest(F.lit(-1), F.least(F.lit(255), F.floor((x + 1.0) * 128.0)))).cast("long")


def state_prompt(prompt: Column, state: Column, ask: bool) -> Column:
    """``Task: ..., State: ...;`` with the digitised state; ``ask`` adds where the action begins."""
    bins = F.array_join(F.transform(state, lambda v: digitize(v).cast("string")), " ")
    return F.concat(F.lit("Task: "), prompt, F.lit(", State: "), bins, F.lit(";\nAction: " if ask else ";\n"))


def fit_tokens(tokens: Column, most: int) -> Column:
    """Cut or filled with 0 to ``most`` tokens."""
    return F.slice(F.concat(tokens, F.array_repeat(F.lit(0).cast("long"), F.greatest(most - F.size(tokens), F.lit(0)))), 1, most)


def token_masks(prefix: Column, postfix: Column) -> tuple[Column, Column]:
    """Autoregressive and loss masks (0/1): off over the prefix, on over the postfix."""
    mask = F.concat(F.array_repeat(F.lit(0).cast("long"), F.size(prefix)), F.array_repeat(F.lit(1).cast("long"), F.size(postfix)))
    return mask, mask


def action_token(token: Column, vocabulary: int) -> Column:
    """Between action tokens and the vocabulary's end; its own inverse."""
    return F.lit(vocabulary - 1 - SKIPPED_TOKENS) - token


def action_text(s: Column) -> Column:
    """What stands between ``Action: `` and the next bar; null without the marker."""
    return F.when(F.instr(s, "Action: ") > 0, strip(F.element_at(F.split(F.element_at(F.split(s, "Action: "), 2), r"\|"), 1)))


def bin_values(tokens: Column, bins: int, horizon: int, dim: int) -> Column:
    """Tokens as a matrix of values in [-1, 1]; zeros if there are too few."""
    n = horizon * dim
    flat = F.when(F.size(tokens) < n, F.array_repeat(F.lit(0.0), n)).otherwise(F.transform(F.slice(tokens, 1, n), lambda t: t / float(bins) * 2.0 - 1.0))
    return F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda i: F.slice(flat, i * dim + 1, dim))


def safe_name(s: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(strip(s), r"[^\p{L}\p{N}_.-]", "_"), 1, most)


def video_name(task: Column, suffix: Column) -> Column:
    """A file name of 250 bytes at most if its text is ASCII: long tasks are cut and get a hash."""
    segment = F.regexp_replace(task, " ", "_")
    name = F.concat(F.lit("rollout_"), segment, F.lit("_"), suffix, F.lit(".mp4"))
    key = F.substring(F.md5(segment.cast("binary")), 1, 12)
    rest = F.concat(F.lit("_"), key, F.lit("_"), suffix, F.lit(".mp4"))
    short = F.concat(F.lit("rollout_"), F.substring(segment, F.lit(1), 250 - 8 - F.char_length(rest)), rest)
    return F.when(F.octet_length(name) > 250, short).otherwise(name)


def merged_prefix(folder: Column) -> Column:
    """The merged cache's path for a folder of shards: by four ordered rules on its name."""
    parent, name = F.regexp_extract(folder, r"^(.*)/[^/]+/?$", 1), F.regexp_extract(folder, r"([^/]+)/?$", 1)
    path = lambda *parts: F.concat(parent, F.lit("/"), *parts)
    rev = r"^_cosmosdit_([A-Za-z0-9_\-]+)_tmp__(.+)$"
    return (
        F.when(name.startswith("_wandit_tmp__"), path(F.lit("backup/wandit_cache__"), F.substring(name, 14, 10_000)))
        .when(name.startswith("_wan21dit_tmp__"), path(F.lit("backup/wan21dit_cache__"), F.substring(name, 16, 10_000)))
        .when(name.rlike(rev), path(F.lit("cosmosdit_"), F.regexp_extract(name, rev, 1), F.lit("_cache__"), F.regexp_extract(name, rev, 2)))
        .otherwise(path(name, F.lit("__merged")))
    )


def revision_tag(revision: Column) -> Column:
    last = F.regexp_replace(F.regexp_extract(revision, r"([^/]*)/*$", 1), "-trained", "")
    last = F.regexp_replace(last, r"[^\p{L}\p{N}_-]", "_")
    return F.when(last == "", "rev").otherwise(last)


def offsets_tag(offsets: Column) -> Column:
    return F.concat(F.lit("f"), F.array_join(F.transform(offsets, lambda v: v.cast("string")), "_"))


def episode_of_metadata(path: Column) -> Column:
    """``..._<id>.json``: after the last underscore, before the first dot."""
    return F.substring_index(F.substring_index(F.regexp_extract(path, r"([^/]*)$", 1), ".", 1), "_", -1)


def step_id(folder: Column, file: Column, t: Column) -> Column:
    return F.concat_ws("--", folder, file, t.cast("string"))


# Images: geometry and value conversions.


def resize_with_pad(height: Column, width: Column, to_height: int, to_width: int) -> dict[str, Column]:
    """Sizes after a resize that keeps proportions, and the padding at the top and left (halves round down)."""
    ratio = F.greatest(width / float(to_width), height / float(to_height))
    h, w = F.floor(height / ratio).cast("long"), F.floor(width / ratio).cast("long")
    half = lambda n: F.floor(n / 2).cast("long")
    return {"height": h, "width": w, "top": half(to_height - h), "left": half(to_width - w), "bottom": to_height - h - half(to_height - h), "right": to_width - w - half(to_width - w)}


def float_to_byte(x: Column) -> Column:
    """[0, 1] to a byte; fractions are cut off and what overflows wraps."""
    return F.pmod((x * 255.0).cast("long"), F.lit(256).cast("long"))


def byte_to_unit(x: Column) -> Column:
    return x / 255.0 * 2.0 - 1.0
