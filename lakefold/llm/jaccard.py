"""N-gram Jaccard join by a blocked sparse product of documents and shingles.

A document's set holds its distinct runs of N words. Two documents link when their sets' Jaccard
similarity reaches a threshold. The join multiplies the sparse incidence matrix of documents and
shingles with its transpose, in blocks of columns and pairs, and computes only entries that can count:

1. Documents with equal sets form a class; only classes are compared.
2. Columns: with shingles in one global order, rare ones first, similar sets share a shingle among
   their first n - ceil(t n) + 1, and it is among the first n - ceil(2 t / (1 + t) n) + 1 of the
   smaller set. Only these columns generate entries. Which shingles count as
   frequent changes the cost, never the result.
3. Blocks: each class goes, with the others that choose the same of their columns, into blocks of about
   BLOCK classes of like size, twice over with other choices, sizes' bounds and blocks. In a block the
   incidence matrix of its members is multiplied with its transpose, a block of columns at a time: first
   of the leading columns, where a class without a partner that can still reach the bound goes, then of
   the whole sets. A block returns its components as stars, so copies of one text join without all of
   their pairs ever being written: what is written grows with the classes, not with a group's square.
   At last, of each column only entries between different components are left: those of classes outside
   its leader's component with the others.
4. For these overlaps are accumulated over the leading columns first. Bounds from the sizes, from the places in
   both sets and from that sum discard entries before their sets are read; all that two sets share lies from
   their first common column on, so a pair that can link passes the bound of its places there. Columns of up to
   FEW classes write such pairs; the rest deal their classes into parts and multiply each two parts as in 3, so
   a large column, however similar its texts, writes classes and stars and no pairs. For the pairs, overlaps are
   accumulated over blocks of the sets in hash order, and a pair goes as soon as what is left can't
   lift it over the bound. Only texts that such a pair or block names are read for their sets.

No pair of one component is generated once it is known to be one, every other entry of the product
is checked exactly, and nothing is capped. Shingles are told apart by 64-bit hashes.

Null, empty and wordless texts have an empty set and link with nothing. Fewer than N words make one
shingle. Rows may repeat, also in id. component_id is null only where all ids of a component are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from . import _text as T
from ._cluster import checkpoint, components, most_frequent

#: Shingles that go last in the order: at most so many, those found most often.
FREQUENT = 1 << 20
#: Classes that meet in a block, and shingles that a block is meant to hold.
BLOCK, BLOCK_SHINGLES = 256, 1 << 22
#: Classes of a column whose last entries are written as pairs; those of a larger one are multiplied in blocks.
FEW = 64
#: Bits of the filters that keep columns and sets without a candidate at home.
FILTER_BITS = 1 << 24


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the text's runs of n words, A-Z in lower case, ascending."""
    buf = (text or "").encode().lower()
    starts, ends = T.words_of(buf)
    if not len(starts):
        return np.empty(0, np.uint64)
    words = T.hash_words(buf, starts, ends)
    return np.unique(T.hash_runs(words, min(n, len(words))))


def _common(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Shingles that occur in several documents of a batch, with their number."""
    T.forget()
    for records in batches:
        for some in T.chunks(records["_text"].to_pylist(), lambda t: len(t or ""), 8 << 20):
            found = [shingles(t, n) for t in some]
            values, count = np.unique(np.concatenate(found), return_counts=True)
            keep = count > 1
            yield pa.RecordBatch.from_pydict({"g": pa.array(values[keep].view(np.int64)), "n": pa.array(count[keep], pa.int64())})


def _sign(batches: Iterator[pa.RecordBatch], n: int, frequent, t: Fraction, at: int) -> Iterator[pa.RecordBatch]:
    """Size, fingerprint and leading columns of each document's set."""
    T.forget()
    common, rank = frequent.value
    for records in batches:
        sizes, prints, leads = [], [], []
        for text in records["_text"].to_pylist():
            own = shingles(text, n)
            sizes.append(len(own))
            prints.append(_fingerprint(own) if len(own) else None)
            if not len(own):
                leads.append(None)
                continue
            m = len(own) - math.ceil(t * len(own)) + 1
            if len(common):
                k = np.searchsorted(common, own).clip(max=len(common) - 1)
                last = np.where(common[k] == own, rank[k], -1)
                by = np.lexsort((own, last))[:m]
                leads.append(own[by].view(np.int64))
            else:
                leads.append(own[:m].view(np.int64))
        new = [pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(leads, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*records.columns[:at], *new], names=[*records.schema.names[:at], "_n", "_fp", "_lead"])


def _fingerprint(own: np.ndarray) -> bytes:
    """16 bytes that tell sets apart, whatever their order."""
    return np.array([T.mix(own).sum(), T.mix(own ^ T.M2).sum() + np.uint64(len(own))], np.uint64).tobytes()


def _multiply(batches: Iterator[pa.RecordBatch], t: Fraction, block: int = 1024) -> Iterator[pa.RecordBatch]:
    """Pairs of sets (sorted hashes) whose overlap, accumulated block by block, reaches its bound."""
    T.forget()
    for records in batches:
        a_id, b_id = records["a"].to_pylist(), records["b"].to_pylist()
        out: list[list] = [[], []]
        held: tuple = (None, None)
        for i, j, x, y in zip(a_id, b_id, records["x"], records["y"], strict=True):
            # the leader's set comes again and again
            if held[0] != j:
                held = j, np.frombuffer(y.as_buffer(), np.uint64)
            if overlaps(np.frombuffer(x.as_buffer(), np.uint64), held[1], t, block):
                out[0].append(i)
                out[1].append(j)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])


def overlaps(x: np.ndarray, y: np.ndarray, t: Fraction, block: int = 1024) -> bool:
    """Whether |x & y| >= t |x | y|, for ascending arrays."""
    need = math.ceil(t / (1 + t) * (len(x) + len(y)))
    if min(len(x), len(y)) < need:
        return False
    found = at = 0
    for k in range(0, len(x), block):
        part = x[k : k + block]
        end = at + int(np.searchsorted(y[at:], part[-1], side="right"))
        other = y[at:end]
        if len(other):
            pos = np.searchsorted(other, part).clip(max=len(other) - 1)
            found += int((other[pos] == part).sum())
        at = end
        if found + min(len(x) - k - len(part), len(y) - at) < need:
            return False
    return found >= need


def _own_sets(batches: Iterator[pa.RecordBatch], n: int, wanted) -> Iterator[pa.RecordBatch]:
    """Sets of the texts whose hash is in the filter; the other texts are not looked at."""
    T.forget()
    bits = wanted.value
    for records in batches:
        k = (records["h"].to_numpy() & (FILTER_BITS - 1)).astype(np.uint64)
        some = np.flatnonzero(bits[k >> np.uint64(6)] >> (k & np.uint64(63)) & np.uint64(1))
        for part in T.chunks(some.tolist(), lambda i: len(records["_text"][i].as_buffer()), 4 << 20):
            prints, sets = [], []
            for i in part:
                own = shingles(records["_text"][i].as_py(), n)
                if len(own):
                    prints.append(_fingerprint(own))
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_pydict({"_fp": pa.array(prints, pa.binary()), "s": pa.array(sets, pa.binary())})


def product(parts: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Overlaps of all pairs of sets: their incidence matrix times its transpose, `width` columns at a time."""
    size = [len(p) for p in parts]
    _, column, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(parts)), size)
    shared = np.flatnonzero(count[column] > 1)
    # columns with one entry only add to the diagonal
    number = np.cumsum(count > 1) - 1
    row, column = row[shared], number[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((len(parts), len(parts)), np.float32)
    for begin in range(0, int((count > 1).sum()), width):
        lo, hi = np.searchsorted(column, (begin, begin + width))
        block = np.zeros((len(parts), min(width, int(column[hi - 1]) - begin + 1)), np.float32)
        block[row[lo:hi], column[lo:hi] - begin] = 1
        out += block @ block.T
    return out


def _blocks(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Consecutive rows that are equal in the first `key` columns; one block is held at a time."""
    now, held = None, []
    for records in batches:
        if not len(records):
            continue
        ids = [records[k].to_numpy() for k in range(key)]
        cuts = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(records)], strict=True):
            own = tuple(int(x[lo]) for x in ids)
            if own != now:
                if held:
                    yield now, held
                now, held = own, []
            held.append(records.slice(lo, hi - lo))
    if held:
        yield now, held


def _flag(batches: Iterator[pa.RecordBatch], t: Fraction) -> Iterator[pa.RecordBatch]:
    """Of rows (r, g, band, k, v, n, lead) in blocks: those with a partner that the leading columns and the sizes leave possible.

    With more columns (c, at) the partner is of another component c, and the places at in both sets leave it possible too.
    """
    T.forget()
    num, den = t.numerator, t.denominator
    for key, held in _blocks(batches, 4):
        rows = pa.Table.from_batches(held).combine_chunks()
        if len(rows) < 2:
            continue
        n = rows["n"].to_numpy()
        more, less = np.maximum.outer(n, n), np.minimum.outer(n, n)
        found = product([x.values.to_numpy() for x in rows["lead"]])
        rest = -(-more * num // den) - 1
        need = -(-(more + less) * num // (num + den))
        able = (found > 0) & (found + rest >= need) & (less * den >= more * num)
        if "c" in rows.column_names:
            c, after = rows["c"].to_numpy(), n - rows["at"].to_numpy()
            able &= np.not_equal.outer(c, c) & (np.minimum.outer(after, after) >= need)
        np.fill_diagonal(able, False)
        some = np.flatnonzero(able.any(1))
        v = rows["v"].to_numpy()[some]
        yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(v), x)) for x in key], pa.array(v)], ["r", "g", "band", "k", "v"])


def _join(batches: Iterator[pa.RecordBatch], t: Fraction) -> Iterator[pa.RecordBatch]:
    """Of rows (r, g, k, v, s) in blocks: their components as stars (a, b)."""
    T.forget()
    num, den = t.numerator, t.denominator
    for _, held in _blocks(batches, 4):
        rows = pa.Table.from_batches(held)
        if len(rows) < 2:
            continue
        v = rows["v"].to_numpy()
        by = np.argsort(v)
        sets = [np.frombuffer(rows["s"][int(i)].as_buffer(), np.uint64) for i in by]
        v, n = v[by], np.array([len(x) for x in sets])
        link = product(sets) * (num + den) >= num * np.add.outer(n, n)
        np.fill_diagonal(link, True)
        root = np.arange(len(v))
        while True:
            low = np.where(link, root, len(v)).min(1)
            if (low == root).all():
                break
            root = low
        out = np.flatnonzero(root != np.arange(len(v)))
        yield pa.RecordBatch.from_arrays([pa.array(v[out]), pa.array(v[root[out]])], ["a", "b"])


def _trim(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """A row per class and leading column that, as far as the filter tells, another class has too."""
    bits = shared.value
    for records in batches:
        v, n = records["v"].to_numpy(), records["n"].to_numpy()
        lead = records["lead"].combine_chunks() if isinstance(records["lead"], pa.ChunkedArray) else records["lead"]
        size = np.diff(lead.offsets.to_numpy())
        g = lead.flatten().to_numpy()
        row = np.repeat(np.arange(len(v)), size)
        at = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
        k = (g & (FILTER_BITS - 1)).astype(np.uint64)
        keep = np.flatnonzero(bits[k >> np.uint64(6)] >> (k & np.uint64(63)) & np.uint64(1))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[keep], v[row[keep]], n[row[keep]], at[keep])], ["g", "v", "n", "at"])


def _filter(keys: DataFrame):
    """A broadcast set of FILTER_BITS bits, those of the keys (column k) set: bounded, however many keys there are."""
    k = F.col("k").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = keys.select(F.shiftright(k, 6).alias("w"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bits)


def near_classes(docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10), id_col: str = "doc_id", text_col: str = "text", text_hash: bool = False) -> DataFrame:
    """Rows (id_col, n_shingles, component_id), one for each row of docs, in no order; with text_hash also xxhash64 of the text."""
    t, spark = Fraction(threshold), docs.sparkSession
    num, den = t.numerator, t.denominator
    base = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    own = base.columns[:-1]
    texts = base.select(F.col("_h").alias("h"), "_text").where("length(_text) > 0")
    often = texts.select("_text").mapInArrow(lambda it: _common(it, n), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    often = most_frequent(checkpoint(often), "n", FREQUENT).toArrow()
    g = often["g"].to_numpy().view(np.uint64)
    by = np.argsort(g)
    frequent = spark.sparkContext.broadcast((g[by], often["n"].to_numpy()[by].clip(max=(1 << 31) - 1).astype(np.int32)))

    schema = StructType([*base.schema.fields[:-1], StructField("_n", LongType()), StructField("_fp", BinaryType()), StructField("_lead", ArrayType(LongType()))])
    signed = checkpoint(base.mapInArrow(lambda it: _sign(it, n, frequent, t, len(own)), schema))
    # th: a text that has the set
    classes = signed.where("_fp is not null").groupBy("_fp").agg(F.min("_id").alias("first_id"), F.min("_h").alias("th"), F.first("_n").alias("n"), F.first("_lead").alias("lead"))
    classes = checkpoint(classes.withColumn("v", F.monotonically_increasing_id()))

    # columns with several classes, and their least class; partial minima go before the shuffle
    columns = classes.select("v", F.explode("lead").alias("g")).groupBy("g").agg(F.count("*").alias("c"), F.min("v").alias("leader")).where("c > 1")
    columns = checkpoint(columns)
    held = _filter(columns.select(F.col("g").alias("k")))
    entries = classes.select("v", "n", "lead").mapInArrow(lambda it: _trim(it, held), "g long, v long, n long, at long")
    shared = checkpoint(entries.join(columns, "g").select("g", "v", "n", "at", "leader", "c"))

    # what two sets of these sizes must have in common, and may still have beyond their leading columns
    need = f"ceil((n + m) * {num}L / {num + den}D - 1e-9)"
    rest = f"ceil(greatest(n, m) * {num}L / {den}D - 1e-9) - 1"
    # holds at the first column that two similar sets share; also bounds the sizes' ratio and the smaller set's places
    can_link = f"least(n - aa, m - ba) >= {need}"

    def promising(meet: DataFrame) -> DataFrame:
        """Pairs of meet, once each, whose leading columns have enough in common."""
        pairs = meet.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        x = classes.select(F.col("v").alias("a"), "n", F.col("lead").alias("x"))
        y = classes.select(F.col("v").alias("b"), F.col("n").alias("m"), F.col("lead").alias("y"))
        return checkpoint(pairs.join(x, "a").join(y, "b").where(f"size(array_intersect(x, y)) + {rest} >= {need}").select("a", "b"))

    # each class chooses its most frequent column and one by hash; the second time bands of size lie elsewhere
    chosen = shared.groupBy("v", "n").agg(F.max(F.struct("c", "g")).alias("x"), F.max(F.struct(F.xxhash64("g").alias("h"), "c", "g")).alias("y"))
    turns = [F.struct(F.lit(r).cast("long").alias("r"), F.col(f"{x}.g").alias("g"), F.col(f"{x}.c").alias("c"), F.floor(2 * F.log2("n") + r / 2).alias("band")) for r, x in enumerate("xy")]
    chosen = chosen.select("v", "n", F.explode(F.array(*turns)).alias("p")).select("v", "n", "p.*")
    most = F.greatest(F.lit(4.0), F.least(F.lit(float(BLOCK)), BLOCK_SHINGLES / F.pow(F.lit(2.0), F.col("band") / 2)))
    chosen = chosen.withColumn("k", F.pmod(F.xxhash64("v", "r"), F.ceil(F.col("c") / most)))
    place = ["r", "g", "band", "k"]

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.repartition(*place).sortWithinPartitions(*place)

    blocks = in_blocks(chosen.select(*place, "v", "n").join(classes.select("v", "lead"), "v").select(*place, "v", "n", "lead"))
    flagged = checkpoint(blocks.mapInArrow(lambda it: _flag(it, t), "r long, g long, band long, k long, v long"))

    def with_sets(nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Sets of the classes, read from the texts again unless they are known."""
        nodes = nodes.distinct()
        if known is not None:
            nodes = nodes.join(known.select("v"), "v", "left_anti")
        wanted = checkpoint(classes.select("v", "_fp", "th").join(nodes, "v", "left_semi"))
        bits = _filter(wanted.select(F.col("th").alias("k")))
        found = texts.mapInArrow(lambda it: _own_sets(it, n, bits), "_fp binary, s binary")
        out = checkpoint(found.join(wanted, "_fp").groupBy("v").agg(F.first("s").alias("s")))
        return out if known is None else known.union(out)

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        x = sets.select(F.col("v").alias("a"), F.col("s").alias("x"))
        y = sets.select(F.col("v").alias("b"), F.col("s").alias("y"))
        return checkpoint(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lambda it: _multiply(it, t), "a long, b long"))

    sets = with_sets(flagged.select("v"))
    links = checkpoint(in_blocks(flagged.join(sets, "v").select(*place, "v", "s")).mapInArrow(lambda it: _join(it, t), "a long, b long"))

    # entries with their component so far, of the columns that hold several
    joined = components(links)
    now = shared.join(joined.select(F.col("node").alias("v"), "root"), "v", "left").select("g", "v", "n", "at", "leader", F.coalesce("root", "v").alias("c"))
    open_columns = now.groupBy("g").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min(F.when(F.col("v") == F.col("leader"), F.col("c"))).alias("lead_c"), F.count("*").alias("classes"), F.sum("n").alias("held")).where("x <> y").drop("x", "y")
    left = checkpoint(now.join(open_columns, "g").select("g", "v", "n", "at", "c", "lead_c", "classes", "held"))
    few = left.where(f"classes <= {FEW}")
    some = few.where("c <> lead_c").select("g", F.col("v").alias("a"), "n", F.col("at").alias("aa"), F.col("c").alias("ac"), "lead_c")
    other = few.select("g", F.col("v").alias("b"), F.col("n").alias("m"), F.col("at").alias("ba"), F.col("c").alias("bc"))
    meet = some.join(other, "g").where(f"ac <> bc and (bc = lead_c or a < b) and {can_link}").select("a", "b")
    second = promising(meet)

    # parts of large columns, each with each other one
    parts = F.ceil(F.greatest(F.col("classes") / (2 * BLOCK), F.col("held") * 2 / BLOCK_SHINGLES))
    dealt = left.where(f"classes > {FEW}").withColumn("parts", parts).withColumn("i", F.expr("pmod(xxhash64(v), parts)"))
    dealt = dealt.withColumn("j", F.explode(F.expr("if(parts = 1, array(0L), filter(sequence(0L, parts - 1), x -> x <> i))")))
    dealt = dealt.select(F.least("i", "j").alias("r"), "g", F.greatest("i", "j").alias("band"), F.lit(0).cast("long").alias("k"), "v", "n", "c", "at")
    apart = in_blocks(dealt.join(classes.select("v", "lead"), "v").select(*place, "v", "n", "lead", "c", "at"))
    apart = checkpoint(apart.mapInArrow(lambda it: _flag(it, t), "r long, g long, band long, k long, v long"))

    sets = with_sets(second.select(F.col("a").alias("v")).union(second.select("b")).union(apart.select("v")), sets)
    stars = in_blocks(apart.join(sets, "v").select(*place, "v", "s")).mapInArrow(lambda it: _join(it, t), "a long, b long")
    roots = components(links.unionByName(verified(second, sets)).unionByName(stars))
    owned = classes.select("v", "_fp", "first_id").join(roots.select(F.col("node").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = owned.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = owned.join(least, "root").select("_fp", "component_id")
    result = [F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("component_id"), *[F.col("_h").alias("text_hash")] * text_hash]
    # rows without a set stay where they are; copies of one text are a skewed join that Spark can split
    alone = signed.where("_fp is null").withColumn("component_id", F.col("_id"))
    linked = signed.where("_fp is not null").join(of, "_fp")
    return linked.select(*result).unionByName(alone.select(*result))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs' rows without those whose component holds a smaller id. Rows with a null id stay, and all rows that have the least id."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = near_classes(docs, **options, text_hash=True).where(f"{id_col} <> component_id")
    gone = found.select(F.col(id_col).alias("_id"), F.col("text_hash").alias("_h")).distinct()
    return docs.join(gone, (docs[id_col] == gone["_id"]) & (F.xxhash64(docs[text_col]) == gone["_h"]), "left_anti")
