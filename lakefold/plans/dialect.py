"""Optional SQL facade: rewrites text of the embedded dialect into Spark SQL with the same meaning.

Covers what differs in spelling or meaning and can be told from the text: == and ISNULL/NOTNULL, GLOB
and REGEXP, LIKE without regard to case, functions with other names, LIMIT a, b, negative
limits, index hints, and parameters ?, ?N, :a, @a and $a. String literals and quoted names
are never touched. Columns stay statically typed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(r"""('(?:[^']|'')*')|("(?:[^"]|"")*"|`[^`]*`|\[[^\]]*\])|(--[^\n]*|/\*.*?\*/)""", re.S)
_RENAMED = {"iif": "if", "group_concat": "string_agg", "length": "char_length", "random": "rand", "printf": "format_string", "format": "format_string"}


def rewrite(text: str) -> str:
    """text in Spark's spelling."""
    kept: list[str] = []

    def hold(m: re.Match) -> str:
        if m[3]:
            return " "
        raw = m[0]
        if m[2] and raw[0] in '"[':
            raw = "`" + raw[1:-1].replace('""', '"').replace("`", "``") + "`"
        elif m[1]:
            raw = "'" + raw[1:-1].replace("\\", "\\\\").replace("''", "\\'") + "'"
        kept.append(raw)
        return f"\x00{len(kept) - 1}\x00"

    out = _TOKEN.sub(hold, text)
    out = re.sub(r"(?i)\b(not\s+indexed|indexed\s+by\s+\w+)\b", " ", out)
    out = re.sub(r"(?i)\b(not\s+)?materialized\b", " ", out)
    out = out.replace("==", "=")
    out = re.sub(r"(?i)\bisnull\b(?!\s*\()", "is null", out)
    out = re.sub(r"(?i)\bnotnull\b|\bnot\s+null\b(?=\s*(?:and|or|\)|,|$))", "is not null", out)
    out = re.sub(r"(?i)\bis\s+not\s+(?!null\b|distinct\b|true\b|false\b)", "is distinct from ", out)
    out = re.sub(r"(?i)\bis\s+(?!null\b|not\b|distinct\b|true\b|false\b)", "is not distinct from ", out)
    out = re.sub(r"(?i)\bglob\s+\x00(\d+)\x00", lambda m: "rlike " + _hold(kept, _glob(kept[int(m[1])])), out)
    out = re.sub(r"(?i)\bregexp\b", "rlike", out)
    out = re.sub(r"(?i)\blike\b(?!\s*\()", "ilike", out)
    out = re.sub(r"(?i)\blimit\s+(\d+)\s*,\s*(-?\d+)", r"limit \2 offset \1", out)
    out = re.sub(r"(?i)\blimit\s+-\d+", "", out)
    out = re.sub(r"(?i)\btotal\s*\(([^()]*)\)", r"coalesce(sum(cast(\1 as double)), 0D)", out)
    out = re.sub(r"(?i)\b(likely|unlikely)\s*\(", "(", out)
    out = re.sub(r"(?i)\b(\w+)(\s*\()", lambda m: (_RENAMED.get(m[1].lower()) or m[1]) + m[2], out)
    out = re.sub(r"(?i)\bnulls\s+(first|last)\b", r"nulls \1", out)
    out = re.sub(r"[@$](?=[A-Za-z_])", ":", out)
    out = re.sub(r"\?(\d+)", r":p\1", out)
    return re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], out)


def _hold(kept: list[str], raw: str) -> str:
    kept.append(raw)
    return f"\x00{len(kept) - 1}\x00"


def _glob(literal: str) -> str:
    """A GLOB literal as a literal of a regular expression."""
    out, i, p = "", 0, literal[1:-1]
    while i < len(p):
        if p[i] == "[" and "]" in p[i + 2 :]:
            end = p.index("]", i + 2)
            out += p[i : end + 1]
            i = end
        else:
            out += {"*": ".*", "?": "."}.get(p[i], re.escape(p[i]).replace("\\", "\\\\"))
        i += 1
    return f"'^{out}$'"


def query(spark: SparkSession, text: str, args: dict | list | None = None) -> DataFrame:
    """Run dialect text; args are named ones, or positional ones for ? and ?N."""
    if isinstance(args, list) and re.search(r"\?\d", text):
        args = {f"p{k + 1}": v for k, v in enumerate(args)}
    out = rewrite(text)
    return spark.sql(out, args) if args else spark.sql(out)
