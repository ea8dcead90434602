"""Substring deduplication by super-k-mers.

A window is WINDOW consecutive words of one document. Each window's minimiser is the least hash of
its MER-word pieces, a function of the window's words alone, so equal windows have equal minimisers.
Consecutive windows that share one travel together, as the text from the first window's first word to
the last one's last word, to the bucket that the minimiser names. A bucket sorts its windows and
compares the words of neighbours with the same hash, so windows are counted exactly.

A map batch first drops windows that it has already met at an earlier place (comparing their words
too), so a passage that a third of all documents hold reaches its bucket once per batch. Buckets are
dealt by their number, and their count follows the input's size.

Order: documents by (doc_id, hash of the text), null ids first. Rows equal in doc_id and text count
as one document and all get its result. Null and empty texts have no words. Extra columns are kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import _text as T


WINDOW, MER = 20, 3
#: Bytes of text that a map batch looks at together, and that a bucket is meant to hold.
BATCH_BYTES, BUCKET_BYTES = 6 << 20, 4 << 20
#: Of these, the bytes whose words are looked at together, and the windows compared together.
SLICE_BYTES, COMPARED = 1 << 19, 1 << 15

_PACK = "bucket int, data binary"
_MARK = "d long, h long, first long, last long"


def _windows(text: bytes, many: np.ndarray, window: int, mer: int = 0) -> list[np.ndarray]:
    """Columns of the windows of a text whose parts have so many words each: part, number of the first word in it, start and end in text, hash and, with mer, minimiser."""
    starts, ends = T.words_of(text)
    words = T.hash_words(text, starts, ends)
    part = np.repeat(np.arange(len(many), dtype=np.int32), np.maximum(many - window + 1, 0))
    before = np.cumsum(many) - many  # a part's first word
    skipped = np.cumsum(np.minimum(many, window - 1)) - np.minimum(many, window - 1)  # words before it that open no window
    at = np.arange(len(part)) + skipped[part]
    low = [T.sliding_min(T.hash_runs(words, mer), window - mer + 1)[at]] if mer and len(at) else [np.empty(0, np.uint64)] * bool(mer)
    whole = T.hash_runs(words, window)
    return [part, at - before[part], starts[at], ends[at + window - 1], whole[at] if len(at) else whole[:0], *low]


def _joined(columns: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
    """One array of each list, which is emptied."""
    for parts in columns:
        yield np.concatenate(parts)
        parts.clear()


def _twice(hashes: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once."""
    by = np.argsort(hashes)
    h = hashes[by]
    same = h[1:] == h[:-1]
    found = np.zeros(len(h), bool)
    found[by[1:][same]] = True
    found[by[:-1][same]] = True
    return np.flatnonzero(found)


def _first_seen(text: bytes, lo: np.ndarray, hi: np.ndarray, hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each window text[lo:hi], whether no equal one is earlier in `order` (ascending ranks; equal ranks are the same place).

    text has single spaces between words, so equal windows are equal bytes.
    """
    first = np.ones(len(hashes), bool)
    by = np.lexsort((order, hashes))
    h = hashes[by]
    new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.ones(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    more = np.flatnonzero(~new)
    same = np.empty(len(more), bool)
    for k in range(0, len(more), COMPARED):
        x, y = by[more[k : k + COMPARED]], by[head[more[k : k + COMPARED]]]
        same[k : k + COMPARED] = [text[a:b] == text[c:d] for a, b, c, d in zip(lo[x].tolist(), hi[x].tolist(), lo[y].tolist(), hi[y].tolist(), strict=True)]
    first[by[more]] = order[by[more]] == order[by[head[more]]]
    for k in np.unique(head[more[~same]]).tolist():  # different words with one hash
        known: dict[bytes, int] = {}
        for i in by[(head == k)].tolist():
            first[i] = known.setdefault(text[lo[i] : hi[i]], order[i]) == order[i]
    return first


def _spans(d: np.ndarray, h: np.ndarray, w: np.ndarray, window: int):
    """Unions of [w, w + window) per document, as columns; rows come in any order."""
    by = np.lexsort((w, h, d))
    d, h, w = d[by], h[by], w[by]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]) | (w[1:] > w[:-1] + window)] if len(w) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(w)][: len(begin)] - 1
    return d[begin], h[begin], w[begin], w[last] + window


def _parts(rows: Iterable[tuple[int, int, bytes]], window: int, most: int) -> Iterator[list[tuple[int, int, int, int, bytes]]]:
    """Batches of (doc, hash, first word's number, words, text); long texts come in parts that overlap by window - 1 words."""
    batch, held = [], 0
    for d, h, text in rows:
        number, tail = 0, []
        for part in T.pieces(text, min(most, SLICE_BYTES)):
            words = part.split()
            now = tail + words
            batch.append((d, h, number - len(tail), len(now), b" ".join(now)))
            number += len(words)
            tail = now[-(window - 1) :]
            held += len(part)
            if held >= most:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def _slices(records: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text."""
    at = 0
    for some in T.chunks(pc.binary_length(records[text]).fill_null(0).to_pylist(), int, most):
        yield records.slice(at, len(some))
        at += len(some)


def _sorted(records: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    d, h, texts = records["d"].to_pylist(), records["h"].to_pylist(), records["text"]
    for i in sorted(range(len(d)), key=lambda i: (d[i], h[i])):
        yield d[i], h[i], texts[i].as_buffer().to_pybytes()


def _pack(batches: Iterator[pa.RecordBatch], buckets: int, window: int, mer: int, most: int) -> Iterator[pa.RecordBatch]:
    T.forget()
    for records in (part for whole in batches for part in _slices(whole, "text", most)):
        for batch in _parts(_sorted(records), window, most):
            ids = np.array([x[:2] for x in batch], np.int64)
            begin, many = np.array([x[2:4] for x in batch], np.int64).T
            size = np.array([len(x[4]) + 1 for x in batch])
            text = b" ".join(x[4] for x in batch)
            batch.clear()
            yield _packed(text, ids, begin, many, size, buckets, window, mer)
            del text
            T.forget()


def _packed(text: bytes, ids: np.ndarray, begin: np.ndarray, many: np.ndarray, size: np.ndarray, buckets: int, window: int, mer: int) -> pa.RecordBatch:
    """A batch's blobs by bucket; of its parts: ids, the first word's number, words, and bytes with the space that follows."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    kind = np.int32 if len(text) < 1 << 31 else np.int64
    columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
    after = np.cumsum(size)
    for some in T.chunks(range(len(size)), size.__getitem__, SLICE_BYTES):
        a, b, at = some[0], some[-1] + 1, int(after[some[0]] - size[some[0]])
        doc, number, lo, hi, hashes, low = _windows(text[at : after[b - 1]], many[a:b], window, mer)
        for column, x in zip(columns, ((doc + a).astype(np.int32), (number + begin[a:b][doc]).astype(kind), (lo + at).astype(kind), (hi + at).astype(kind), hashes, low), strict=True):
            column.append(x)
    doc, number, lo, hi, hashes, low = _joined(columns)
    found: list[tuple[int, bytes]] = []
    first = np.ones(len(doc), bool)
    if len(twice := _twice(hashes)):
        # rows of one document have one place; equal rows are adjacent
        same = np.r_[0, np.cumsum((ids[1:] != ids[:-1]).any(1))]
        first[twice] = _first_seen(text, lo[twice], hi[twice], hashes[twice], same[doc[twice]] << 40 | number[twice])
        gone = np.flatnonzero(~first)
        if len(gone):
            spans = _spans(ids[doc[gone], 0], ids[doc[gone], 1], number[gone].astype(np.int64), window)
            found.append((-1, z.compress(np.stack(spans, 1).astype("<i8").tobytes())))
    del hashes, twice
    keep = np.flatnonzero(first)
    if len(keep):
        k_low, k_number, k_doc = low[keep], number[keep], doc[keep]
        new = np.flatnonzero(np.r_[True, (k_low[1:] != k_low[:-1]) | (k_number[1:] != k_number[:-1] + 1) | (k_doc[1:] != k_doc[:-1])])
        last = np.r_[new[1:], len(keep)] - 1
        bucket = (k_low[new] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        new, last, bucket = new[by], last[by], bucket[by]
        lo, hi = lo[keep[new]].tolist(), hi[keep[last]].tolist()
        head = np.column_stack([ids[k_doc[new]], k_number[new], last - new + window]).astype("<i8")
        del low, number, doc, keep, k_low, k_number, k_doc
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        # a blob is about a slice at most: a run of windows and its numbers take some 128 bytes
        most = max(1, SLICE_BYTES >> 7)
        for a, b in ((k, min(k + most, b)) for a, b in zip(cuts, cuts[1:], strict=False) for k in range(a, b, most)):
            # columns one after another, ids as differences: small once compressed
            part = head[a:b]
            part[1:, 0] = np.diff(part[:, 0])
            body = b" ".join(text[x:y] for x, y in zip(lo[a:b], hi[a:b], strict=True))
            found.append((int(bucket[a]), z.compress(np.array([b - a], "<i8").tobytes() + part.T.tobytes() + body)))
    return pa.RecordBatch.from_pydict({"bucket": pa.array([x for x, _ in found], pa.int32()), "data": pa.array([x for _, x in found], pa.binary())})


def _count(blobs: list[pa.Buffer], window: int):
    """Spans of the windows of one bucket that have an equal, earlier one."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    body, heads, columns, held, parts = [], [], [[], [], [], [], []], 0, 0
    for some in T.chunks((z.decompress(x) for x in blobs), len, SLICE_BYTES):
        head = []
        for raw in some:
            n = int(np.frombuffer(raw, "<i8", 1)[0])
            head.append(np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n).copy())
            head[-1][0] = np.cumsum(head[-1][0])
        text = b" ".join(memoryview(raw)[8 + 32 * x.shape[1] :] for raw, x in zip(some, head, strict=True))
        heads += head
        part, number, lo, hi, hashes = _windows(text, np.concatenate([x[3] for x in head]), window)
        for column, x in zip(columns, (part + parts, number.astype(np.int32), lo + held, hi + held, hashes), strict=True):
            column.append(x)
        body.append(text)
        held += len(text) + 1
        parts += sum(x.shape[1] for x in head)
    text = b" ".join(body)
    del body
    d, h, begin, _ = np.concatenate(heads, axis=1)
    part, number, lo, hi, hashes = _joined(columns)
    twice = _twice(hashes)
    part, number, lo, hi, hashes = part[twice], number[twice], lo[twice], hi[twice], hashes[twice]
    d, h, w = d[part], h[part], begin[part] + number
    rank = np.empty(len(w), np.int64)
    by = np.lexsort((w, h, d))
    rank[by] = np.cumsum(np.r_[0, (d[by][1:] != d[by][:-1]) | (h[by][1:] != h[by][:-1]) | (w[by][1:] != w[by][:-1])])[: len(by)]
    gone = np.flatnonzero(~_first_seen(text, lo, hi, hashes, rank))
    return _spans(d[gone], h[gone], w[gone], window)


def _sort(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by bucket; one bucket is held at a time."""
    T.forget()

    def spans(bucket, blobs):
        if bucket == -1:
            import zstandard

            for x in blobs:
                yield np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8").reshape(-1, 4).T
        else:
            yield _count(blobs, window)
            T.forget()

    def rows():
        bucket, held = None, []
        for records in batches:
            for b, data in zip(records["bucket"].to_pylist(), records["data"], strict=True):
                if b != bucket or b == -1:
                    if held:
                        yield from spans(bucket, held)
                    bucket, held = b, []
                held.append(data.as_buffer())
        if held:
            yield from spans(bucket, held)

    for columns in rows():
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x), pa.int64()) for x in columns], ["d", "h", "first", "last"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, mer: int = MER, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (d, h, first, last): words [first, last) of document (d, h) are covered by windows that also start earlier.

    docs has d, h (long) and text, none null. Spans may overlap.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(size / bucket_bytes))
    packed = docs.select("d", "h", "text").mapInArrow(lambda it: _pack(it, buckets, window, mer, batch_bytes), _PACK)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 8)
    # spans found in the map are spread over all tasks, not sent to one
    dealt = packed.repartition(tasks, F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(F.xxhash64("data")))
    return dealt.sortWithinPartitions("bucket").mapInArrow(lambda it: _sort(it, window), _MARK)


def _cut(batches: Iterator[pa.RecordBatch], at: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    T.forget()
    for records in (part for whole in batches for part in _slices(whole, "_text", BATCH_BYTES)):
        texts, spans = records["_text"].to_pylist(), records["_spans"].to_pylist()
        kept, n_words, n_removed, digest = [], [], [], []
        for text, cuts in zip(texts, spans, strict=True):
            words = (text or "").encode().split()
            n = len(words)
            if cuts:
                gone = np.zeros(n + 1, np.int64)
                for x in cuts:
                    gone[x["first"]] += 1
                    gone[x["last"]] -= 1
                left = (np.cumsum(gone[:-1]) == 0).tolist()
                words = [w for w, ok in zip(words, left, strict=True) if ok]
            body = b" ".join(words)
            kept.append(body)
            n_words.append(n)
            n_removed.append(n - len(words))
            digest.append(hashlib.sha256(body).hexdigest())
        new = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays([*records.columns[:at], *new], schema=pa.schema([*list(records.schema)[:at], *schema]))


NEW = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, keep: list[str] | None = None, **options) -> DataFrame:
    """docs' columns `keep` (all but the text by default) with n_words, n_removed, kept_sha256 and kept_text.

    Words covered by a window of 20 whose words also start earlier go; what is left is joined by one
    space. A column of docs with a new column's name is replaced.
    """
    new = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col and c not in NEW.names]
    order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    base = docs.select(*keep, F.col(text_col).alias("_text"), order.alias("_d"), F.hash(id_col, text_col).cast("long").alias("_h"))
    marks = repeated_spans(base.where("length(_text) > 0").select(F.col("_d").alias("d"), F.col("_h").alias("h"), F.col("_text").alias("text")), **options)
    marks = marks.groupBy("d", "h").agg(F.collect_set(F.struct("first", "last")).alias("_spans"))
    both = base.join(marks, (base["_d"] == marks["d"]) & (base["_h"] == marks["h"]), "left").select(*keep, "_text", "_spans")
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*both.schema.fields[: len(keep)], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), StructField("kept_text", StringType())])
    return both.mapInArrow(lambda it: _cut(it, len(keep), NEW), schema).select(*keep, *new)


