"""JSON text: reading stays in the JVM; edits by path run in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def minify(x: Column) -> Column:
    """The text without white space between tokens; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(x))


def valid(x: Column) -> Column:
    return F.when(x.isNotNull(), F.try_parse_json(x).isNotNull())


def extract(x: Column, *paths: str) -> Column:
    """One path: the value as text, a string without quotes. Several: a JSON array."""
    if len(paths) == 1 and "#" not in paths[0]:
        return F.get_json_object(x, paths[0])
    if len(paths) == 1:
        return _edit(lambda v, p: _plain(_get(v, p)), x, paths[0])
    return _edit(lambda v, *p: json.dumps([_get(v, q) for q in p], separators=(",", ":"), ensure_ascii=False), x, *paths)


def arrow(x: Column, path: str) -> Column:
    """x -> path: always JSON."""
    return _edit(lambda v, p: None if _find(v, p) is None else _dump(_get(v, p)), x, _full(path))


def arrow_text(x: Column, path: str) -> Column:
    """x ->> path."""
    return extract(x, _full(path))


def _full(path: str) -> str:
    return path if path.startswith("$") else f"$[{path}]" if path.lstrip("-").isdigit() else f"$.{path}"


def array(*cols: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[quote(c) for c in cols]), F.lit("]"))


def object_(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def quote(x: Column) -> Column:
    """A JSON value: text in quotes, numbers plain, null for NULL."""
    one = F.to_json(F.struct(x.alias("x")), {"ignoreNullFields": "false"})
    return F.substring(one, F.lit(6), F.char_length(one) - 6)


def array_length(x: Column, path: str = "$") -> Column:
    """Null where the path is missing; 0 where it isn't an array."""
    part = x if path == "$" else F.get_json_object(x, path)
    return F.coalesce(F.json_array_length(part), F.when(part.isNotNull(), F.lit(0)))


def type_(x: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object."""
    names = {dict: "object", list: "array", str: "text", int: "integer", float: "real", type(None): "null"}
    return _edit(lambda v, p: None if (f := _find(v, p)) is None else str(f[0]).lower() if isinstance(f[0], bool) else names[type(f[0])], x, path)


def error_position(x: Column) -> Column:
    """1-based place of the first error, 0 if there is none."""

    @F.pandas_udf("int")
    def where(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                json.loads(t)
                return 0
            except json.JSONDecodeError as e:
                return e.pos + 1

        return s.map(one).astype("Int32")

    return where(x)


def set_(x: Column, path: str, value) -> Column:
    return _edit(lambda v, p: _dump(_put(v, p, value, True, True)), x, path)


def insert(x: Column, path: str, value) -> Column:
    return _edit(lambda v, p: _dump(_put(v, p, value, True, False)), x, path)


def replace(x: Column, path: str, value) -> Column:
    return _edit(lambda v, p: _dump(_put(v, p, value, False, True)), x, path)


def remove(x: Column, *paths: str) -> Column:
    def drop(v, *ps):
        for p in ps:
            steps = _steps(p)
            held = _walk(v, steps[:-1])
            if held is not None and _has(held[0], steps[-1]):
                del held[0][_index(held[0], steps[-1])]
        return _dump(v)

    return _edit(drop, x, *paths)


def patch(x: Column, y: Column) -> Column:
    """RFC 7396 merge of y into x."""

    def merge(a, b):
        if not isinstance(b, dict):
            return b
        out = dict(a) if isinstance(a, dict) else {}
        for k, v in b.items():
            if v is None:
                out.pop(k, None)
            else:
                out[k] = merge(out.get(k), v)
        return out

    @F.pandas_udf(StringType())
    def both(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else _dump(merge(json.loads(a), json.loads(b))) for a, b in zip(s, t, strict=True)], dtype=object)

    return both(x, y)


def pretty(x: Column, indent: str = "    ") -> Column:
    return _edit(lambda v: json.dumps(v, indent=indent, ensure_ascii=False), x)


def _dump(v) -> str:
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _plain(v):
    return v if v is None or isinstance(v, str) else _dump(v)


def _edit(fn, x: Column, *args: str) -> Column:
    """fn(parsed value, *args) over texts, in Arrow batches; null for null and for what isn't JSON."""

    @F.pandas_udf(StringType())
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            try:
                out.append(None if t is None else fn(json.loads(t), *args))
            except json.JSONDecodeError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(x)


def _steps(path: str) -> list:
    """$.a."b c"[0][#-1] as keys and (index, from the end)."""
    out = []
    for m in re.finditer(r'\.(?:"([^"]*)"|([^.\[]+))|\[(#?)(-?\d+)?\]', path):
        out.append(m[1] if m[1] is not None else m[2] if m[2] is not None else (int(m[4] or 0), m[3] == "#"))
    return out


def _index(v, step):
    return step if isinstance(step, str) else len(v) + step[0] if step[1] else step[0]


def _has(v, step) -> bool:
    if isinstance(step, str):
        return isinstance(v, dict) and step in v
    return isinstance(v, list) and 0 <= _index(v, step) < len(v)


def _walk(v, steps):
    """[value], or None where there is none."""
    for s in steps:
        if not _has(v, s):
            return None
        v = v[_index(v, s)]
    return [v]


def _find(v, path: str):
    return _walk(v, _steps(path))


def _get(v, path: str):
    found = _find(v, path)
    return None if found is None else found[0]


def _put(v, path: str, value, add: bool, change: bool):
    steps = _steps(path)
    if not steps:
        return value if change else v
    held = _walk(v, steps[:-1])
    if held is not None:
        at, last = held[0], steps[-1]
        if _has(at, last):
            if change:
                at[_index(at, last)] = value
        elif add:
            if isinstance(at, dict) and isinstance(last, str):
                at[last] = value
            elif isinstance(at, list) and not isinstance(last, str) and _index(at, last) == len(at):
                at.append(value)
    return v
