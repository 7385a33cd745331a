"""Arrays on the wire: a map of type, shape and bytes in MessagePack.

Only what the format needs is written and read here: small maps, strings,
byte strings, whole numbers and arrays.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KIND, SHAPE, DATA = "dtype", "shape", "data"


def dumps(x) -> bytes:
    if x is None:
        return b"\xc0"
    if isinstance(x, (bool, np.bool_)):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, (np.ndarray, np.generic)):
        if x.dtype.kind in "VOc":
            raise ValueError(f"Unsupported dtype: {x.dtype}")
        return dumps({KIND: x.dtype.str, SHAPE: list(x.shape), DATA: x.tobytes()})
    if isinstance(x, int):
        return b"\xd3" + struct.pack(">q", x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        b = x.encode()
        return b"\xdb" + struct.pack(">I", len(b)) + b
    if isinstance(x, bytes):
        return b"\xc6" + struct.pack(">I", len(x)) + x
    if isinstance(x, (list, tuple)):
        return b"\xdd" + struct.pack(">I", len(x)) + b"".join(map(dumps, x))
    if isinstance(x, dict):
        return b"\xdf" + struct.pack(">I", len(x)) + b"".join(dumps(k) + dumps(v) for k, v in x.items())
    raise TypeError(f"can't pack {type(x)}")


def loads(b: bytes):
    value, _ = _load(b, 0)
    return value


def _load(b: bytes, at: int):
    tag, at = b[at], at + 1
    if tag in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[tag], at
    if tag in (0xD3, 0xCB):
        return struct.unpack(">q" if tag == 0xD3 else ">d", b[at : at + 8])[0], at + 8
    (n,) = struct.unpack(">I", b[at : at + 4])
    at += 4
    if tag in (0xDB, 0xC6):
        raw = b[at : at + n]
        return (raw.decode() if tag == 0xDB else raw), at + n
    out = []
    for _ in range(n * (2 if tag == 0xDF else 1)):
        v, at = _load(b, at)
        out.append(v)
    if tag == 0xDD:
        return out, at
    d = dict(zip(out[::2], out[1::2], strict=True))
    if set(d) == {KIND, SHAPE, DATA}:
        a = np.frombuffer(d[DATA], np.dtype(d[KIND])).reshape(d[SHAPE])
        return (a if d[SHAPE] else a[()]), at
    return d, at


def pack(data: Column) -> Column:
    """Bytes as an array of unsigned bytes on the wire."""

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: dumps(np.frombuffer(b, np.uint8)))

    return run(data)


def unpack(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: loads(b).tobytes())

    return run(data)
