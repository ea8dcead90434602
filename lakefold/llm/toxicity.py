"""Toxicity by a factorisation machine over hashed terms.

A text's features are its distinct terms (words in lower case, without punctuation at their ends)
and their stems (first 4 and 5 characters), hashed into 2**20 buckets. The score is the logistic of a bias, a weight per term and, for each pair
of terms, the product of their short vectors: the pairs let an insult count otherwise beside the
mention of a group than alone. All pairs are summed in time linear in the terms.

The model is fitted on the driver from at most MAX_LABELLED labelled rows, those with the least hash
of doc_id; only texts and labels.toxic are used, never lang, source, quality or ids. An id with several
labels counts once, as toxic if one says so, and one that several rows share with its least text. Every text is
scored whole. Null, empty and wordless texts get the score of no terms. Without labelled rows, or
with one class only, every score is the (smoothed) share of the label. Null labels are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._text import WordCache, chunks, forget

MAX_LABELLED = 20_000
BUCKETS, FACTORS, MIN_DOCS = 1 << 20, 4, 10
#: Inflected languages: words are also told by their first characters.
STEMS = (4, 5)
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 256, 0.02, 6e-4, 7
ENDS = b".,;:!?\"'()[]{}<>|-_*#$%&/\\~`^+=@"

def _hashes(word: bytes) -> bytes:
    """Of the term and of its stems, its first 4 and 5 characters."""
    term = word.lower().strip(ENDS)
    if not term:
        return b""
    text = term.decode()
    every = dict.fromkeys([term, *(b"%d:" % k + text[:k].encode() for k in STEMS if len(text) >= k)])
    return np.array([zlib.crc32(t) & (BUCKETS - 1) for t in every], "<i4").tobytes()


_TERMS = WordCache(lambda words: [_hashes(w) for w in words])


def term_ids(text: str | None) -> np.ndarray:
    """Distinct hashed terms and stems of a text, ascending."""
    words = list(set((text or "").encode().split()))
    return np.unique(np.frombuffer(b"".join(_TERMS(words)), "<i4"))


def fit(rows: list[tuple[int, np.ndarray]]) -> dict:
    """Factorisation machine for (label, term ids) rows: known terms (sorted), bias, weights, vectors."""
    y = np.array([r[0] for r in rows], np.float32)
    share = float((y.sum() + 0.5) / (len(y) + 1))
    empty = {"terms": np.empty(0, np.int32), "bias": float(np.log(share / (1 - share))), "w": np.empty(0, np.float32), "v": np.empty((0, FACTORS), np.float32)}
    if not len(y) or y.min() == y.max():
        return empty
    flat = np.concatenate([r[1] for r in rows]) if rows else np.empty(0, np.int32)
    terms, count = np.unique(flat, return_counts=True)
    terms = terms[count >= min(MIN_DOCS, max(1, len(y) // 50))]
    if not len(terms):
        return empty
    size = np.array([len(r[1]) for r in rows])
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    at = np.empty(len(flat), np.int32)
    for a in range(0, len(flat), 1 << 20):
        at[a : a + (1 << 20)] = np.searchsorted(terms, flat[a : a + (1 << 20)]).clip(max=len(terms) - 1)
    known = terms[at] == flat
    at, doc = at[known], doc[known]
    begin = np.searchsorted(doc, np.arange(len(rows) + 1))
    rnd = np.random.default_rng(SEED)
    # one table: column 0 the weight, the others the vector
    table = np.concatenate([np.zeros((len(terms), 1)), rnd.normal(0, 0.01, (len(terms), FACTORS))], 1).astype(np.float32)
    m, s, bias, mb, sb, step = np.zeros_like(table), np.zeros_like(table), empty["bias"], 0.0, 0.0, 0
    least = max(EPOCHS, -(-400 * BATCH // len(rows)))
    for _ in range(min(least, 60)):
        order = rnd.permutation(len(rows))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            n = begin[some + 1] - begin[some]
            first = np.cumsum(n) - n
            take = np.repeat(begin[some] - first, n) + np.arange(n.sum())
            ids, own = at[take], np.repeat(np.arange(len(some)), n)
            if not len(ids):
                continue
            used, local = np.unique(ids, return_inverse=True)
            x = table[ids]
            sums = _by_doc(x, first, n)
            squares = _by_doc(x[:, 1:] ** 2, first, n)
            out = bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1)
            g = (1 / (1 + np.exp(-out.clip(-30, 30))) - y[some]) / len(some)
            grad = np.empty_like(x)
            grad[:, 0] = g[own]
            grad[:, 1:] = g[own, None] * (sums[own, 1:] - x[:, 1:])
            total = np.stack([np.bincount(local, grad[:, k], len(used)) for k in range(grad.shape[1])], 1) + DECAY * table[used]
            step += 1
            m[used] = 0.9 * m[used] + 0.1 * total
            s[used] = 0.999 * s[used] + 0.001 * total**2
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            table[used] -= RATE * (m[used] / c1) / (np.sqrt(s[used] / c2) + 1e-8)
            gb = float(g.sum())
            mb, sb = 0.9 * mb + 0.1 * gb, 0.999 * sb + 0.001 * gb * gb
            bias -= RATE * (mb / c1) / (np.sqrt(sb / c2) + 1e-8)
    return {"terms": terms, "bias": float(bias), "w": table[:, 0].copy(), "v": table[:, 1:].copy()}


def _by_doc(x: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, n of them for each document."""
    total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, 0, dtype=np.float64)])
    return total[first + n] - total[first]


def predict(model: dict, texts: list[str | None]) -> np.ndarray:
    """Score of each text, 0 to 1."""
    found = [term_ids(t) for t in texts]
    n = np.array([len(x) for x in found])
    flat = np.concatenate(found) if found else np.empty(0, np.int32)
    terms = model["terms"]
    out = np.full(len(texts), model["bias"])
    if len(flat) and len(terms):
        at = np.searchsorted(terms, flat).clip(max=len(terms) - 1)
        known = (terms[at] == flat)[:, None]
        first = np.cumsum(n) - n
        v = np.where(known, model["v"][at], 0)
        sums = _by_doc(v, first, n)
        out += _by_doc(np.where(known, model["w"][at, None], 0), first, n)[:, 0] + 0.5 * (sums**2 - _by_doc(v**2, first, n)).sum(1)
    return 1 / (1 + np.exp(-out.clip(-500, 500)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget(_TERMS)
    for records in batches:
        ids = [term_ids(t).astype("<i4").tobytes() for t in records["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([records["y"], pa.array(ids, pa.binary())], ["y", "ids"])


def train(docs: DataFrame, labels: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_LABELLED) -> dict:
    """Fit on the labelled documents for which `learn` (a condition on doc_id) holds."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    if learn is not None:
        rows = rows.where(learn)
    # at most `most` rows of two numbers: small enough to broadcast at any size of the input
    share = min(1.0, 1.1 * most / max(1, rows.count()))
    # the least hashes lie below this bound, so each task offers about its part of them
    some = rows.where(F.xxhash64("doc_id").cast("double") <= (2 * share - 1) * 2.0**63)
    sample = some.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    # one text for each id, however many rows share it: `most` rows at the most
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("y", "text")
    found = texts.mapInArrow(_features, "y int, ids binary").collect()
    found.sort(key=lambda r: (r["y"], bytes(r["ids"])))
    return fit([(r["y"], np.frombuffer(r["ids"], "<i4")) for r in found])


def _score(batches: Iterator[pa.RecordBatch], model, at: int) -> Iterator[pa.RecordBatch]:
    forget(_TERMS)
    for records in batches:
        texts = records["_text"].to_pylist()
        out = np.concatenate([predict(model.value, some) for some in chunks(texts, lambda t: len(t or ""), 2 << 20)]) if texts else np.empty(0)
        yield pa.RecordBatch.from_arrays([*records.columns[:at], pa.array(out, pa.float64())], names=[*records.schema.names[:at], "score"])


def score(docs: DataFrame, model: dict, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) and score. A column of docs named score is replaced."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*rows.schema.fields[: len(keep)], StructField("score", DoubleType())])
    return rows.mapInArrow(lambda it: _score(it, sent, len(keep)), schema)
