"""Variable-capacity best-fit packing.

Documents become token sequences (words, and one end) that fill bins of several permitted lengths.
A document longer than the longest is cut into parts of that length and a rest, so every token is
packed once. Items come by falling length. Each goes where it leaves the least room among the open
bins (best fit). If none has room, a bin opens, of the size whose cost per token that it can still
get is least: a bin of C positions costs C + C * C / ATTENTION, the second part standing for
attention. What it can get is found by filling each size from the lengths to come that no open bin
counts on, at the cost of the size it would shrink to; the bin then counts on these. Of
sizes that cost the same the largest opens, with room for what no bin counted on. At last each bin
shrinks to the least permitted length that holds its contents.

Rows are dealt round-robin to groups that are packed on their own, of at most GROUP_ITEMS items:
repeated rows and frequent ids spread evenly, and a group of that size leaves less than a bin of each
length half empty. Only lengths travel, never texts.

Null and empty texts are an end alone, one token. Rows may repeat, also in id; each is packed.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

CAPACITIES = (256, 512, 1024, 2048, 4096)
ATTENTION, GROUP_ITEMS = 8192, 200_000
#: Rows a group is meant to hold.
GROUP_ROWS = 50_000
NEW = ("part", "start", "n_tokens", "bin_id", "bin_capacity", "bin_tokens", "bin_offset")


def cost(capacity: int) -> float:
    return capacity + capacity * capacity / ATTENTION


class _Supply:
    """Lengths to come that no open bin counts on."""

    def __init__(self, lengths: np.ndarray, most: int):
        self.count = np.bincount(lengths, minlength=most + 1).tolist()
        self.lower = list(range(most + 1))

    def below(self, n: int) -> int:
        """The greatest length up to n of which some are left, or 0."""
        at = n
        while at and not self.count[at]:
            self.lower[at] = min(self.lower[at], at - 1)
            at = self.lower[at]
        while n > at:
            self.lower[n], n = at, self.lower[n]
        return at

    def fill(self, n: int, size: int) -> tuple[int, list[tuple[int, int]]]:
        """What a bin of that size gets after an item of n, longest first: its contents, and lengths with how many."""
        room, found, at = size - n, [], n
        while room and (at := self.below(min(at, room))):
            k = min(self.count[at], room // at)
            found.append((at, k))
            room -= k * at
            at -= 1
        return size - room, found


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For items no longer than the largest capacity: each one's bin and offset, and each bin's capacity and contents."""
    sizes = sorted(capacities)
    most = sizes[-1]
    free: list[list[int]] = [[] for _ in range(most + 1)]
    some = np.zeros(most + 1, bool)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    opened, held = [], []
    supply = _Supply(lengths, most)
    rest = supply.count.copy()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        rest[n] -= 1
        supply.count[n] = min(supply.count[n], rest[n])
        room = n + int(some[n:].argmax())
        if some[room]:
            k = free[room].pop()
            some[room] = bool(free[room])
        else:
            filled = [(c, *supply.fill(n, c)) for c in sizes if c >= n]
            room, _, taken = min(filled, key=lambda f: (cost(sizes[bisect_left(sizes, f[1])]) / f[1], -f[0]))
            for length, count in taken:
                supply.count[length] -= count
            k = len(opened)
            opened.append(room)
            held.append(0)
        bins[i], offsets[i] = k, held[k]
        held[k] += n
        if room > n:
            free[room - n].append(k)
            some[room - n] = True
    contents = np.array(held, np.int64)
    return bins, offsets, np.array(sizes, np.int64)[np.searchsorted(sizes, contents)], contents


def _pack(batches: Iterator[pa.RecordBatch], capacities: tuple[int, ...], at: int, most_items: int) -> Iterator[pa.RecordBatch]:
    longest = max(capacities)
    base = TaskContext.get().partitionId() << 40
    held: list[pa.RecordBatch] = []
    items = 0

    def out():
        nonlocal base
        table = pa.Table.from_batches(held).combine_chunks()
        n = table["_n"].to_numpy()
        parts = -(-n // longest)
        row = np.repeat(np.arange(len(n)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = part * longest
        size = np.minimum(longest, n[row] - start)
        bins, offsets, capacity, contents = best_fit(size, capacities)
        new = [part, start, size, bins + base, capacity[bins], contents[bins], offsets]
        base += len(capacity)
        kept = table.select(table.column_names[:at]).take(pa.array(row))
        for name, x in zip(NEW, new, strict=True):
            kept = kept.append_column(name, pa.array(x, pa.int64()))
        return kept.to_batches(max_chunksize=20_000)

    for records in batches:
        for a in range(0, len(records), 4096):
            some = records.slice(a, 4096)
            held.append(some)
            items += int((-(-some["_n"].to_numpy() // longest)).sum())
            if items >= most_items:
                yield from out()
                held, items = [], 0
    if items:
        yield from out()


def pack(docs: DataFrame, text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, keep: list[str] | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per part of a document: docs' columns `keep` (all but the text by default), part, start, n_tokens, bin_id, bin_capacity, bin_tokens, bin_offset.

    A column of docs with a new column's name is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col and c not in NEW]
    words = F.coalesce(F.regexp_count(text_col, F.lit(r"[^ \t\n\r\x0B\f]+")), F.lit(0))
    rows = docs.select(*keep, (words + 1).cast("long").alias("_n"))
    groups = max(1, math.ceil(docs.count() / group_rows))
    schema = StructType([*rows.schema.fields[: len(keep)], *[StructField(c, LongType()) for c in NEW]])
    return rows.repartition(groups).mapInArrow(lambda it: _pack(it, tuple(capacities), len(keep), GROUP_ITEMS), schema)
