"""Words, hashes and pieces of text, vectorised over bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def words_of(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes that are not ASCII white space) of buf."""
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = SPACE[np.frombuffer(buf, np.uint8)]
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def hash_words(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end], eight bytes at a time."""
    out = (ends - starts).astype(np.uint64)
    eight = np.ndarray((len(buf) + 1,), "<u8", buf + bytes(8), strides=(1,))
    at, left, rest = starts, ends - starts, slice(None)
    while len(at):
        now = eight[at] & _MASKS[np.minimum(left, 8)]
        out[rest] = _join(out[rest], now)
        more = np.flatnonzero(left > 8)
        rest = more if isinstance(rest, slice) else rest[more]
        at, left = at[more] + 8, left[more] - 8
    return mix(out)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b)."""
    a = (a ^ (a >> np.uint64(29))) * M1
    return (a ^ (a >> np.uint64(32))) + b * M2


def hash_runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive word hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, done, part, size = None, 0, words, 1
    while True:
        if n & size:
            piece = part[done : done + m]
            out = piece if out is None else _join(out, piece)
            done += size
        size *= 2
        if size > n:
            return mix(out)
        part = _join(part[: -(size // 2)], part[size // 2 :])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    if len(x) < n:
        return x[:0]
    done, low = 1, x
    while done < n:
        step = min(done, n - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return low


def chunks(items: Iterable, weight, most: int) -> Iterator[list]:
    """Consecutive slices of items whose weights sum to about most."""
    out, total = [], 0
    for x in items:
        out.append(x)
        total += weight(x)
        if total >= most:
            yield out
            out, total = [], 0
    if out:
        yield out


def pieces(buf: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """buf cut at white space into parts of about most bytes; no word is cut."""
    at = 0
    while len(buf) - at > most:
        end = at + most
        while end < len(buf) and not SPACE[buf[end]]:
            end += 1
        yield buf[at:end]
        at = end
    yield buf[at:]


#: What holds results in this worker process and can forget them.
_HOLDERS: weakref.WeakSet = weakref.WeakSet()


def remembered(holder) -> None:
    _HOLDERS.add(holder)


def forget(*but) -> None:
    """Drop what other operators have left in a worker that Spark uses again, and hand freed memory back to the system."""
    kept = {id(x) for x in but}
    if any([x.forget() for x in list(_HOLDERS) if id(x) not in kept]):
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes that a cache's younger half may hold, by estimate; the older half holds no more.
CACHE_BYTES = 40 << 20
#: Longer words are not remembered.
LONGEST = 64


class WordCache:
    """Encodes many repeated strings through a batch encoder, remembering results in two generations of `limit` bytes.

    When the younger is full the older goes, so what occurs often stays. No encoding is None.
    """

    def __init__(self, encode, limit: int = CACHE_BYTES):
        self.encode, self.limit, self.seen, self.old, self.held = encode, limit, {}, {}, 0
        remembered(self)

    def forget(self) -> bool:
        """Whether there was anything to forget."""
        held = bool(self.seen)
        self.seen, self.old, self.held = {}, {}, 0
        return held

    def __call__(self, words: list) -> list:
        """The result for each word."""
        out = list(map(self.seen.get, words))
        at = [k for k, x in enumerate(out) if x is None]
        if at:
            new = self._new(list(dict.fromkeys(map(words.__getitem__, at))))
            for k in at:
                out[k] = new[words[k]]
        return out

    def _new(self, words: list) -> dict:
        old = self.old
        found = {w: old[w] for w in words if w in old}
        fresh = [w for w in words if w not in found]
        if fresh:
            found.update(zip(fresh, self.encode(fresh), strict=True))
        keep = {w: x for w, x in found.items() if len(w) <= LONGEST}
        # what Python takes for a short string, a short result and their place
        self.held += sum(map(len, keep)) + 250 * len(keep)
        if self.held > self.limit:
            self.old, self.seen, self.held = self.seen, {}, sum(map(len, keep)) + 250 * len(keep)
        self.seen.update(keep)
        return found
