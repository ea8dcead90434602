"""Functions that return tables."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import udtf


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """start, start + step, ... up to and with stop; a step of 0 counts as 1."""
    step = step or 1
    n = max(0, (stop - start) // step + 1)
    return spark.range(n).select((F.lit(start) + F.col("id") * step).cast("long").alias("value"))


def wholenumber(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1).select(F.col("id").alias("value"))


def carray(spark: SparkSession, values: list) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], ["value"])


def prefixes(df: DataFrame, col: str, out: str = "prefix") -> DataFrame:
    """One row per prefix of a text, the longest first, the empty one last."""
    return df.withColumn(out, F.explode(F.transform(F.sequence(F.char_length(col), F.lit(0)), lambda n: F.substring(F.col(col), F.lit(1), n))))


def next_char(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Characters that follow prefix in the column, each once."""
    rest = df.where(F.col(col).startswith(prefix) & (F.char_length(col) > len(prefix)))
    return rest.select(F.substring(col, len(prefix) + 1, 1).alias("next")).distinct()


_NAMES = {dict: "object", list: "array", str: "text", int: "integer", float: "real", type(None): "null"}
_PLAIN = re.compile(r"[A-Za-z_]\w*")
# parsed text holds no circles
_compact = json.JSONEncoder(check_circular=False, separators=(",", ":"), ensure_ascii=False).encode


def _text(v) -> str | None:
    kind = type(v)
    if kind is str or v is None:
        return v
    if kind is int or kind is float and math.isfinite(v):
        return repr(v)
    return _compact(v) if v or not isinstance(v, (dict, list)) else "{}" if kind is dict else "[]"


def _rows(key, v, parent, path, full, deep, counter):
    # what waits to be read, the next one last
    waiting = [(key, v, parent, path, full)]
    while waiting:
        key, v, parent, path, full = waiting.pop()
        me = counter[0]
        counter[0] += 1
        leaf = not isinstance(v, (dict, list))
        text = _text(v)
        yield None if key is None else str(key), text, _NAMES.get(type(v)) or text, text if leaf else None, me, parent, full, path
        if deep and v and not leaf:
            members = v.items() if isinstance(v, dict) else enumerate(v)
            waiting += reversed([(k, x, me, full, full + _step(k)) for k, x in members])


def _step(k) -> str:
    return f"[{k}]" if isinstance(k, int) else f".{k}" if _PLAIN.fullmatch(k) else f'."{k}"'


_SCHEMA = "key string, value string, type string, atom string, id int, parent int, fullkey string, path string"


def each(df: DataFrame, col: str) -> DataFrame:
    """df with a row per direct member of a JSON object or array, all in the JVM: key, value, type, fullkey.

    Text that isn't JSON, and null, have no rows; a value that is neither object nor array is one row
    without key. An object's members come by name. Numbers keep their value, not their spelling.
    """
    doc = F.try_parse_json(F.col(col))
    # variant_explode reads objects and arrays; anything else stands for itself
    kind = F.schema_of_variant(doc)
    deep = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    rows = df.withColumn("_doc", doc).where("_doc is not null").withColumn("_deep", deep)
    inside = rows.where("_deep").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_doc").outer()))
    inside = inside.select(*df.columns, F.coalesce("key", F.col("pos").cast("string")).alias("key"), F.col("value").alias("_v"), _place("key", "pos").alias("fullkey"))
    alone = rows.where("not _deep").select(*df.columns, F.lit(None).cast("string").alias("key"), F.col("_doc").alias("_v"), F.lit("$").alias("fullkey"))
    both = inside.unionByName(alone)
    name = F.schema_of_variant("_v")
    text = F.variant_get("_v", "$", "string")
    kind = (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "text").when(name == "VOID", "null")
        .when(name == "BOOLEAN", text).when(name == "BIGINT", "integer").when(name.rlike(r"^DECIMAL\(\d+,0\)$"), "integer").otherwise("real")
    )
    return both.select(*df.columns, "key", text.alias("value"), kind.alias("type"), "fullkey")


def _place(key: str, pos: str):
    plain = F.col(key).rlike(r"^[A-Za-z_][A-Za-z0-9_]*$")
    return F.when(F.col(key).isNull(), F.concat(F.lit("$["), F.col(pos).cast("string"), F.lit("]"))).when(plain, F.concat(F.lit("$."), key)).otherwise(F.concat(F.lit('$."'), key, F.lit('"')))


#: Rows that tree() hands on at once, and characters of their values.
ROWS, CHARS = 10_000, 4 << 20
_TREE = pa.schema([("key", pa.string()), ("value", pa.string()), ("type", pa.string()), ("atom", pa.string()), ("id", pa.int32()), ("parent", pa.int32()), ("fullkey", pa.string()), ("path", pa.string())])


def tree(df: DataFrame, col: str) -> DataFrame:
    """df with a row per element of a JSON text, parents first: key, value, type, atom, id, parent, fullkey, path.

    Null has no rows, and text that isn't JSON is an error. Texts go to Python and rows come back in
    Arrow batches of some ROWS rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in batches:
            for at, made in _tree_batches(records[col].to_pylist()):
                yield pa.RecordBatch.from_arrays([*records.take(at).columns, *made.columns], names=[*records.schema.names, *made.schema.names])

    made = ", ".join(f"`{f.name}` {'int' if f.type == pa.int32() else 'string'}" for f in _TREE)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(rows, f"{kept}, {made}")


def _tree_batches(texts: list) -> Iterator[tuple[pa.Array, pa.RecordBatch]]:
    """Batches of the texts' elements, each with the numbers of their texts."""
    at, out, chars = [], [], 0
    for k, text in enumerate(texts):
        if text is None:
            continue
        for r in _rows(None, json.loads(text), None, "$", "$", True, [0]):
            at.append(k)
            out.append(r)
            chars += len(r[1] or "")
            if len(out) >= ROWS or chars >= CHARS:
                yield _tree_batch(at, out)
                at, out, chars = [], [], 0
    if out:
        yield _tree_batch(at, out)


def _tree_batch(at: list, rows: list) -> tuple[pa.Array, pa.RecordBatch]:
    return pa.array(at, pa.int64()), pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _TREE, strict=True)], schema=_TREE)


@udtf(returnType=_SCHEMA)
class JsonTree:
    """Every element below a JSON text, parents first."""

    def eval(self, text: str):
        if text is not None:
            yield from _rows(None, json.loads(text), None, "$", "$", True, [0])


@udtf(returnType=_SCHEMA)
class JsonEach:
    """The direct members of a JSON object or array, or the value itself."""

    def eval(self, text: str):
        if text is None:
            return
        v = json.loads(text)
        if not isinstance(v, (dict, list)):
            yield from _rows(None, v, None, "$", "$", False, [0])
            return
        counter = [1]
        for k, x in v.items() if isinstance(v, dict) else enumerate(v):
            yield from ((*r[:5], None, *r[6:]) for r in _rows(k, x, None, "$", "$" + _step(k), False, counter))


def register(spark: SparkSession) -> SparkSession:
    """json_tree and json_each for LATERAL joins in SQL."""
    spark.udtf.register("json_tree", JsonTree)
    spark.udtf.register("json_each", JsonEach)
    return spark
