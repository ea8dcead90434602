"""Bytes: hex, base 85, hashes, compression, deltas of texts."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType, StringType


def unhex(x: Column) -> Column:
    """Null when it isn't hexadecimal."""
    return F.when(F.char_length(x) % 2 == 0, F.try_to_binary(x, F.lit("hex")))


def zeroblob(n: int) -> Column:
    return F.unhex(F.repeat(F.lit("00"), max(0, n)))


def _bytes(fn, kind=BinaryType()):
    def wrap(x: Column) -> Column:
        @F.pandas_udf(kind)
        def run(s: pd.Series) -> pd.Series:
            return pd.Series([None if v is None else fn(bytes(v)) for v in s], dtype=object)

        return run(x.cast("binary"))

    return wrap


sha3 = _bytes(lambda v: hashlib.sha3_256(v).digest())
compress = _bytes(zlib.compress)
uncompress = _bytes(zlib.decompress)
base85 = _bytes(lambda v: base64.b85encode(v).decode(), StringType())
unbase85 = _bytes(base64.b85decode)


def sha1(x: Column) -> Column:
    return F.sha1(x.cast("binary"))
