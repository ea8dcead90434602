"""Text: substrings, patterns, trimming, quoting and formatting under the dialect's rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def substr(x: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a negative start counts from the end, a negative length takes the characters before start, and start 0 stands before the first."""
    start = F.lit(start) if isinstance(start, int) else start
    size = F.char_length(x)
    # first: number of characters before the one that start names
    first = F.when(start > 0, start - 1).when(start < 0, size + start).otherwise(F.lit(-1))
    if length is None:
        begin, end = F.greatest(first, F.lit(0)), size
    else:
        n = F.lit(length) if isinstance(length, int) else length
        begin = F.greatest(F.when(n < 0, first + n).otherwise(first), F.lit(0))
        end = F.when(n < 0, first).otherwise(first + n)
        end = F.when((n < 0) & (start == 0), F.lit(0)).otherwise(end)
    take = F.greatest(F.least(end, size) - begin, F.lit(0))
    return F.substring(x, (begin + 1).cast("int"), take.cast("int"))


def instr(x: Column, y: Column) -> Column:
    return F.instr(x, y)


def like(x: Column, pattern: str, escape: str | None = None) -> Column:
    """Regardless of case, with % and _; no character escapes unless one is named."""
    out = "".join(_like_part(m, escape) for m in re.finditer(r"(?s)" + (re.escape(escape) + "(.)|" if escape else "(?!)(.)|") + "(.)", pattern))
    return x.rlike(f"(?is)\\A{out}\\z")


def _like_part(m: re.Match, escape: str | None) -> str:
    if m[1] is not None:
        return re.escape(m[1])
    return {"%": ".*", "_": "."}.get(m[2], re.escape(m[2]))


def glob(x: Column, pattern: str) -> Column:
    """Case matters; * ? [abc] [a-z] [^x]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + 1
            negated = pattern[j : j + 1] == "^"
            j += negated
            end = pattern.find("]", j + 1)
            if end < 0:
                return F.lit(False) & x.isNotNull()
            body = re.sub(r"([\\\[\]&^])", r"\\\1", pattern[j:end])
            out += f"[{'^' * negated}{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return x.rlike(f"(?s)\\A{out}\\z")


def regexp(x: Column, pattern: str, ignore_case: bool = False) -> Column:
    return x.rlike(("(?i)" if ignore_case else "") + pattern)


def trim(x: Column, chars: str = " ") -> Column:
    return F.btrim(x, F.lit(chars))


def ltrim(x: Column, chars: str = " ") -> Column:
    return F.ltrim(x, F.lit(chars))


def rtrim(x: Column, chars: str = " ") -> Column:
    return F.rtrim(x, F.lit(chars))


def replace(x: Column, old: Column, new: Column) -> Column:
    return F.when(old == "", x).otherwise(F.replace(x, old, new))


def concat(*cols: Column) -> Column:
    """Skips nulls, unlike ||."""
    return F.concat_ws("", *cols)


def quote(x: Column, kind: str = "text") -> Column:
    """An SQL literal: 'it''s', 1, X'00', NULL."""
    if kind == "blob":
        text = F.concat(F.lit("X'"), F.hex(x), F.lit("'"))
    elif kind == "text":
        text = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'"))
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def unicode(x: Column) -> Column:
    """First code point."""
    return F.when(F.char_length(x) > 0, F.conv(F.hex(F.encode(F.substring(x, 1, 1), "UTF-32")), 16, 10).cast("int"))


def char(*codes: Column) -> Column:
    """Text of code points."""
    return F.concat(*[F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32") for c in codes])


def soundex(x: Column) -> Column:
    """First letter and three digits; letters without a digit and other characters part equal digits. ?000 without letters."""
    word = F.regexp_replace(x, "^[^A-Za-z]+", "")
    codes = F.translate(F.upper(F.regexp_replace(word, "[^A-Za-z]", "0")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    rest = F.regexp_replace(F.regexp_replace(codes, r"(\d)\1+", "$1"), "^.|0", "")
    return F.when(word == "", F.lit("?000")).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.rpad(F.substring(rest, 1, 3), 3, "0")))


def typeof(x: Column, kind: str) -> Column:
    """kind: the Spark type's name; storage classes are static here but for null."""
    name = "integer" if kind in ("tinyint", "smallint", "int", "bigint", "boolean") else "real" if kind in ("float", "double") or kind.startswith("decimal") else "blob" if kind == "binary" else "text"
    return F.when(x.isNull(), F.lit("null")).otherwise(F.lit(name))


_SPEC = re.compile(r"%([-+ 0#,!]*)(\*|\d+)?(?:\.(\*|\d+))?(?:l|ll)?([a-zA-Z%])")


def printf(pattern: str, *args: Column) -> Column:
    """Formatted text; missing arguments count as 0 or ''. Conversions d i u f e E g G x X o c s q Q w p %."""
    parts: list[Column] = []
    rest, at = list(args), 0
    for m in _SPEC.finditer(pattern):
        if m.start() > at:
            parts.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        flags, width, precision, kind = m.groups()
        if kind == "%":
            parts.append(F.lit("%"))
            continue
        if width == "*" or precision == "*":
            raise ValueError("widths must be given in the pattern")
        parts.append(_convert(flags, int(width or 0), None if precision is None else int(precision), kind, rest.pop(0) if rest else None))
    parts.append(F.lit(pattern[at:]))
    return F.concat(*parts)


def _convert(flags: str, width: int, precision: int | None, kind: str, arg: Column | None) -> Column:
    if kind in "diu":
        x = F.coalesce((F.lit(0) if arg is None else arg).cast("long"), F.lit(0).cast("long"))
        body = F.format_number(F.abs(x), 0) if "," in flags else F.abs(x).cast("string")
        if precision:
            body = F.when(F.char_length(body) < precision, F.lpad(body, precision, "0")).otherwise(body)
        return _pad(body, F.when(x < 0, "-").otherwise("+" if "+" in flags else " " if " " in flags else ""), flags, width)
    if kind in "feEgG":
        x = F.coalesce((F.lit(0) if arg is None else arg).cast("double"), F.lit(0.0))
        body = F.format_string(f"%.{6 if precision is None else precision}{kind}", F.abs(x)) if kind not in "gG" else _general(F.abs(x), 6 if precision is None else max(1, precision), kind)
        return _pad(body, F.when(x < 0, "-").otherwise("+" if "+" in flags else " " if " " in flags else ""), flags, width)
    if kind in "xXop":
        x = F.coalesce((F.lit(0) if arg is None else arg).cast("long"), F.lit(0).cast("long"))
        body = F.conv(x.cast("string"), 10, 8) if kind == "o" else F.hex(x)
        body = F.lower(body) if kind == "x" else body
        prefix = {"x": "0x", "X": "0X", "o": "0"}.get(kind, "") if "#" in flags else ""
        return _pad(body, F.lit(prefix), flags, width)
    text = F.coalesce((F.lit("") if arg is None else arg).cast("string"), F.lit("(NULL)" if kind in "qw" and arg is not None else ""))
    if kind == "c":
        text = F.substring(text, 1, 1)
    elif kind == "q":
        text = F.replace(text, F.lit("'"), F.lit("''"))
    elif kind == "Q":
        text = F.lit("NULL") if arg is None else F.coalesce(F.concat(F.lit("'"), F.replace(arg.cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    elif kind == "w":
        text = F.replace(text, F.lit('"'), F.lit('""'))
    if precision is not None and kind != "c":
        text = F.substring(text, 1, precision)
    return _pad(text, F.lit(""), flags.replace("0", ""), width)


def _general(x: Column, digits: int, kind: str) -> Column:
    """Fixed or with an exponent, whichever %g takes, without trailing zeros."""
    power = F.when(x == 0, F.lit(0)).otherwise(F.regexp_extract(F.format_string(f"%.{digits - 1}e", x), r"e([+-]\d+)$", 1).cast("int"))
    fixed = F.lit(None).cast("string")
    for p in range(-5, digits):
        fixed = F.when(power == p, F.format_string(f"%.{max(0, digits - 1 - p)}f", x)).otherwise(fixed)
    fixed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    exponent = F.regexp_replace(F.format_string(f"%.{digits - 1}e", x), r"\.?0*e", "e")
    out = F.when((power < -4) | (power >= digits), exponent).otherwise(fixed)
    return F.upper(out) if kind == "G" else out


def _pad(body: Column, sign: Column, flags: str, width: int) -> Column:
    if not width:
        return F.concat(sign, body)
    whole = F.concat(sign, body)
    if "-" in flags:
        return F.when(F.char_length(whole) < width, F.rpad(whole, width, " ")).otherwise(whole)
    if "0" in flags:
        zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.char_length(whole), F.lit(0)))
        return F.concat(sign, zeros, body)
    return F.when(F.char_length(whole) < width, F.lpad(whole, width, " ")).otherwise(whole)
