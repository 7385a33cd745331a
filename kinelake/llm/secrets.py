"""Secrets in texts: three plain patterns, and strings of high entropy.

Beyond the patterns, a candidate is a long run of one class of characters. A
window slides over it; how often each character stands in the window is kept up
by one addition and one removal a step, and so is the sum of n * log2(n) over
these counts, from which the window's Shannon entropy follows (in whole
multiples of 2**-32, so that long runs gather no error). Windows of enough bits a
character for their class are joined to spans. An allow-list suppresses spans
that are no secrets by their look or by what stands before them. What the
patterns find is never suppressed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import common

#: The kinds that the patterns find, in the order in which they are listed, and their patterns.
BASE = ("assign", "access", "hex")


def _either(word: str) -> str:
    """A word in either case of each of its letters; the letters of ASCII only."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(rf"""({"|".join(map(_either, KEYS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
#: What a text must hold, in lower case, for a match of ASSIGN.
HINTS = ("password", "passwd", "secret", "token", "api")


class Kind(NamedTuple):
    """A class of characters: its runs are candidates; a window of ``width`` characters needs ``bits`` a character, and a match of each of ``needs``."""

    name: str
    characters: str
    width: int
    bits: float
    needs: tuple[str, ...]

    def runs(self) -> re.Pattern:
        return re.compile(rf"(?<![{self.characters}])[{self.characters}]{{{self.width},}}")


#: Random characters reach about 3.5 bits in 24 of hex, 4.4 in 24 of base64; words and names, 3.0 and 3.8. Digits alone are numbers, so letters are needed, too.
KINDS = (Kind("entropy_hex", "0-9A-Fa-f", 24, 3.0, ("[0-9]", "[A-Fa-f]")), Kind("entropy_base64", "A-Za-z0-9+/_=-", 24, 4.0, ("[0-9]", "[a-z]", "[A-Z]")))

#: Suppressed are spans whose text matches one of these ...
ALLOWED = (
    r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}",  # UUIDs
    r"(?i)example|placeholder|dummy|sample|changeme|redacted",
    r"(?i)abcdefghij|0123456789|qwertyuiop",
    r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_/+=](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+\Z",  # names of several words
)
#: ... or before which the text ends with one of these: digests given as such, addresses, embedded data.
ALLOWED_BEFORE = (r"(?i)\b(?:sha-?(?:1|224|256|384|512)|md5|integrity|checksum|commit|etag)[\s\"'=:-]{0,4}\Z", r"(?i)\b[a-z][a-z0-9+.-]*://\S{0,2000}\Z", r"(?i)\bdata:[a-z]+/[\w.+-]+;base64,\Z")
#: Characters before a span that are looked at.
BEFORE = 2100

SCALE = 1 << 32


def tables(width: int) -> list[int]:
    """n * log2(n) for counts up to ``width``, in multiples of 1 / SCALE."""
    return [0] + [round(n * math.log2(n) * SCALE) for n in range(1, width + 1)]


def high_windows(run: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Joined windows (start, end) of ``run`` that have ``bits`` a character or more; overlapping ones are one."""
    n_log_n = tables(width)
    most = n_log_n[width] - math.ceil(bits * width * SCALE)  # bits * width = width * log2(width) - sum of n * log2(n)
    counts: dict[str, int] = {}
    total, start, end = 0, -1, -1
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += n_log_n[n + 1] - n_log_n[n] if n < width else 0
        if i >= width:  # n is at most ``width`` here, as one goes for each that comes
            out = run[i - width]
            n = counts[out]
            counts[out] = n - 1
            total += n_log_n[n - 1] - n_log_n[min(n, width)]
        if i >= width - 1 and total <= most:
            first = i - width + 1
            if first > end:
                if end >= 0:
                    yield start, end
                start = first
            end = i + 1
    if end >= 0:
        yield start, end


class Scanner:
    """Finds spans ``(kind, start, end)`` in a text, by start, then by kind in the order of the lists."""

    def __init__(self, kinds: Sequence[Kind] = KINDS, allowed: Sequence[str] = ALLOWED, allowed_before: Sequence[str] = ALLOWED_BEFORE):
        self.kinds = [(k, k.runs(), [re.compile(x) for x in k.needs]) for k in kinds]
        self.allowed, self.before = [re.compile(x) for x in allowed], [re.compile(x) for x in allowed_before]
        self.order = {k: i for i, k in enumerate((*BASE, *(k.name for k in kinds)))}

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found = [("access", *m.span()) for m in ACCESS.finditer(text)] + [("hex", *m.span()) for m in HEX.finditer(text)]
        low = text.lower()  # may be longer than the text, so no place in it is used
        if any(h in low for h in HINTS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
        return found

    def suppressed(self, text: str, start: int, end: int) -> bool:
        span, head = text[start:end], text[max(0, start - BEFORE) : start]
        return any(x.search(span) for x in self.allowed) or any(x.search(head) for x in self.before)

    def added(self, text: str, known: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
        """Spans of high entropy that aren't inside one that is known, each by the first class that finds it."""
        known = list(known)
        for kind, runs, needs in self.kinds:
            for m in runs.finditer(text):
                run = m[0]
                if not all(x.search(run) for x in needs):
                    continue
                for a, b in high_windows(run, kind.width, kind.bits):
                    start, end = m.start() + a, m.start() + b
                    if all(x.search(text, start, end) for x in needs) and not any(s <= start and end <= e for _, s, e in known) and not self.suppressed(text, *m.span()):
                        known.append((kind.name, start, end))
                        yield known[-1]

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        base = self.base(text)
        return sorted(base + list(self.added(text, base)), key=lambda x: (x[1], self.order[x[0]], x[2]))


def find_secrets(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", kinds: Sequence[Kind] = KINDS, allowed: Sequence[str] = ALLOWED, allowed_before: Sequence[str] = ALLOWED_BEFORE) -> DataFrame:
    """One row a document: ``doc_id, spans``, an array of ``kind, start, end`` (code points, without the end).

    Spans of the kinds in ``BASE`` are whole matches of their patterns; those of
    ``kinds`` are added, unless they lie inside another or are allowed. Null and
    empty texts have none; repeated rows give repeated rows, an empty table none;
    other columns are not read. Nothing is shuffled.
    """
    docs = common.documents(df, id_col, text_col)
    scan = Scanner(kinds, allowed, allowed_before)

    @F.pandas_udf("array<struct<kind: string, start: bigint, end: bigint>>")
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"kind": k, "start": s, "end": e} for k, s, e in scan(t)])

    return docs.select("doc_id", spans("text").alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
