"""Numbers: rounding, logarithms, bit operations and division under the dialect's rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

MAX_LONG = (1 << 63) - 1


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def guarded(fn, x: Column) -> Column:
    """fn(x) as a double; null where it isn't a number."""
    return _finite(fn(x.cast("double")))


def max_of(*cols: Column) -> Column:
    """Largest argument; null if any is null."""
    return F.when(_any_null(cols), F.lit(None)).otherwise(F.greatest(*cols))


def min_of(*cols: Column) -> Column:
    return F.when(_any_null(cols), F.lit(None)).otherwise(F.least(*cols))


def _any_null(cols) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c.isNull()
    return out


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Always a double; negative digits count as none."""
    return F.round(x.cast("double"), max(0, digits))


def sign(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("int")


def ln(x: Column) -> Column:
    return F.when(x.cast("double") > 0, F.ln(x.cast("double")))


def log10(x: Column) -> Column:
    return F.when(x.cast("double") > 0, F.log10(x.cast("double")))


def log2(x: Column) -> Column:
    return F.when(x.cast("double") > 0, F.log2(x.cast("double")))


def log(x: Column, base: Column | None = None) -> Column:
    """log(x) is to base 10; null outside the domain."""
    return log10(x) if base is None else F.when((base > 0) & (base != 1), ln(x) / ln(base))


def sqrt(x: Column) -> Column:
    return F.when(x.cast("double") >= 0, F.sqrt(x.cast("double")))


def trunc(x: Column) -> Column:
    return F.signum(x.cast("double")) * F.floor(F.abs(x.cast("double")))


def fmod(x: Column, y: Column) -> Column:
    return F.try_mod(x.cast("double"), y.cast("double"))


def int_div(a: Column, b: Column) -> Column:
    """Truncating division; null for a zero divisor."""
    a, b = a.cast("long"), b.cast("long")
    return F.call_function("div", a, F.nullif(b, F.lit(0).cast("long")))


def int_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of a, both as integers; null for a zero divisor."""
    return F.try_mod(a.cast("long"), b.cast("long"))


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def shift_left(x: Column, n: Column) -> Column:
    """A negative count shifts right; 64 and more leave nothing."""
    return _shift(x, n.cast("long"))


def shift_right(x: Column, n: Column) -> Column:
    return _shift(x, -n.cast("long"))


def _shift(x: Column, n: Column) -> Column:
    x = x.cast("long")
    by = n.cast("int")
    left = F.call_function("shiftleft", x, by)
    right = F.call_function("shiftright", x, -by)
    return F.when(n >= 64, F.lit(0).cast("long")).when(n >= 0, left).when(n > -64, right).otherwise(F.when(x < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long"))


def to_integer(x: Column) -> Column:
    """Integer value of a text, null if anything is lost."""
    return F.when(F.trim(x).rlike(r"^[+-]?\d+$"), x.try_cast("long"))


def to_real(x: Column) -> Column:
    return x.try_cast("double")


def lenient_int(x: Column) -> Column:
    """Leading integer of a text, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("long"), F.when(x.isNotNull(), F.lit(0).cast("long")))


def lenient_real(x: Column) -> Column:
    """Leading number of a text, else 0.0."""
    return F.coalesce(F.nullif(F.regexp_extract(x, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double"), F.when(x.isNotNull(), F.lit(0.0)))


def zorder(*cols: Column) -> Column:
    """Bits of the (non-negative) arguments interleaved, first argument lowest."""
    n, out = len(cols), F.lit(0).cast("long")
    for bit in range(63 // n):
        for k, c in enumerate(cols):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")), bit * n + k))
    return out


def unzorder(z: Column, n: int, k: int) -> Column:
    """Argument k of n of a zorder value."""
    out = F.lit(0).cast("long")
    for bit in range(63 // n):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(z, bit * n + k).bitwiseAND(F.lit(1).cast("long")), bit))
    return out


def ieee754(x: Column) -> Column:
    """Struct (mantissa, exponent) with x = mantissa * 2 ** exponent, mantissa odd or zero."""


    @F.pandas_udf("mantissa long, exponent long")
    def split(s: pd.Series) -> pd.DataFrame:
        rows = []
        for v in s:
            if v is None or v != v:
                rows.append((None, None))
                continue
            top, bottom = float(v).as_integer_ratio()
            shift = (top & -top).bit_length() - 1 if top and bottom == 1 else 0
            rows.append((top >> shift, shift) if bottom == 1 else (top, 1 - bottom.bit_length()))
        return pd.DataFrame(rows, columns=["mantissa", "exponent"]).astype("Int64")

    return split(x.cast("double"))
