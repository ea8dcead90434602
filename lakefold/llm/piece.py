"""SentencePiece BPE encoding by a merge-type prefix table.

Merging takes the best adjacent pair first. If merging a text gives tokens t1 .. tn, then every two
neighbours alone also merge to just themselves, and a row of tokens with that property is the only
one. So each prefix of a text has one last token: the one that ends there and fits the last token
of the prefix before it. An automaton names the pieces that end at each character, a test of the
pair (remembered) finds the one that fits, and the ids are recovered from the end backwards. The
time is linear in the text, whatever its length.

Pieces hold the space mark only as a first character or in runs of it, and some characters in no
longer piece: texts are cut there into chunks that cannot join, and short chunks are remembered.
Null texts count as empty, and empty texts have no ids but the begin and end ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._text import WordCache, chunks, forget, remembered

SPACE, INF = "▁", float("inf")
_ENCODERS: dict[str, PieceEncoder] = {}


class PieceEncoder:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.bytes, self.score, self.ids = {}, {}, {}
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.bytes[int(piece[3:5], 16)] = k
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                self.score[piece], self.ids[piece] = sp.get_score(k), k
        self.size = {k: len(p) for p, k in self.ids.items()}
        self.text = {k: p for p, k in self.ids.items()}
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        longer = {c for p in self.ids if len(p) > 1 for c in p}
        if not longer <= self.known or any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("this vocabulary joins text in ways that the chunks don't allow")
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in longer)
        self.chunk = re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.automaton = ahocorasick.Automaton()
        for p, k in self.ids.items():
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.spines: dict[tuple[int, int], list | None] = {}
        self.cache = WordCache(lambda some: [self.pack(c) for c in some], 72 << 20)
        remembered(self)

    def forget(self) -> bool:
        held = bool(self.fits)
        self.fits, self.spines = {}, {}
        return held

    def merged(self, text: str) -> list[str]:
        """Merging by definition: the best pair, of equal ones the leftmost, until none is a piece. For short texts."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, side: int) -> list | None:
        """How the token's end on one side (0: left, -1: right) grows: (part, score of the next merge, when its other half is there).

        When: the least score among the merges below, as merges go by falling score. None if the
        token does not merge from its own text.
        """
        key = token, side
        if key not in self.spines:
            piece = self.text[token]
            when, split, parts = dict.fromkeys(range(len(piece)), INF), {}, [(c, k) for k, c in enumerate(piece)]
            fresh = len(piece)
            while len(parts) > 1:
                found = [(self.score[x[0] + y[0]], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x[0] + y[0] in self.score]
                if not found:
                    break
                s, i = max(found)
                x, y = parts[-i], parts[1 - i]
                split[fresh] = x, y, s
                when[fresh] = min(s, when[x[1]], when[y[1]])
                parts[-i : 2 - i] = [(x[0] + y[0], fresh)]
                fresh += 1
            out: list | None = None
            if len(parts) == 1:
                node, out = parts[0], [(piece, -INF, -INF)]
                while node[1] in split:
                    x, y, s = split[node[1]]
                    node, other = (x, y) if side == 0 else (y, x)
                    out.append((node[0], s, when[other[1]]))
                out.reverse()
            self.spines[key] = out
        return self.spines[key]

    def fit(self, before: int, token: int) -> bool:
        """Whether token can follow before (-1: nothing)."""
        key = before << 32 | token
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 300_000:
                self.fits.clear()
            ok = self.fits[key] = self._fit(before, token)
        return ok

    def _fit(self, before: int, token: int) -> bool:
        right, left = self.spine(token, 0), self.spine(before, -1) if before >= 0 else None
        if right is None or before < 0 or left is None:
            return right is not None and before < 0
        i = j = 0
        now, score = INF, self.score
        while True:
            (a, sa, oa), (b, sb, ob) = left[i], right[j]
            across = score.get(a + b, -INF)
            la, lb = sa if oa >= now else min(sa, oa), sb if ob >= now else min(sb, ob)
            best = max(across, la, lb)
            if best == -INF:
                return True
            if (across == best) + (la == best) + (lb == best) > 1 or now in (oa, ob) and now < INF:
                # equal scores go by place: merge by definition
                own = [self.text[before], self.text[token]]
                return self.merged("".join(own)) == own
            if across == best:
                return False
            now = min(now, best)
            i, j = i + (la == best), j + (lb == best)

    def encode_known(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        size, fits, fit = self.size, self.fits, self.fit
        last = [-1] * (len(text) + 1)
        for end, token in self.automaton.iter(text):
            if last[end + 1] < 0:
                start = end + 1 - size[token]
                before = last[start] if start else -1
                if start and before < 0:
                    continue
                ok = fits.get(before << 32 | token)
                if ok or ok is None and fit(before, token):
                    last[end + 1] = token
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return out[::-1]

    def encode_chunk(self, text: str) -> list[int]:
        known = self.known
        if all(map(known.__contains__, text)):
            return self.encode_known(text)
        out, at = [], 0
        for i, c in enumerate(text):
            if c not in known:
                out += self.encode_known(text[at:i])
                out += [self.bytes[b] for b in c.encode()]
                at = i + 1
        return out + self.encode_known(text[at:])

    def pack(self, text: str) -> bytes:
        return np.array(self.encode_chunk(text), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without begin and end."""
        split = [self.chunk.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        ids, out, at = self.cache([c for x in split for c in x]), [], 0
        for x in split:
            out.append(b"".join(ids[at : at + len(x)]))
            at += len(x)
        return out


def encoder(path: str) -> PieceEncoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


NEW = {"n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType(), "decoded_text": StringType()}


def _encode(batches: Iterator[pa.RecordBatch], path: str, at: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    forget(enc, enc.cache)
    bos, eos = (int(x).to_bytes(4, "little") for x in (enc.bos, enc.eos))
    for records in batches:
        n, ids_hash, text_hash, texts = [], [], [], []
        for some in chunks([t or "" for t in records["_text"].to_pylist()], len, 2 << 20):
            for body in enc.encode(some):
                ids = bos + body + eos
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                back = enc.library.decode(np.frombuffer(ids, "<u4").tolist())
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
                if with_text:
                    texts.append(back)
        new = [pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())] + [pa.array(texts, pa.string())] * with_text
        yield pa.RecordBatch.from_arrays([*records.columns[:at], *new], names=[*records.schema.names[:at], *[c for c in NEW if with_text or c != "decoded_text"]])


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", with_text: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all but the text by default) with n_tokens, ids_sha256, decoded_sha256 and decoded_text.

    A column of docs with a new column's name is replaced. model is a path that the executors have.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col and c not in NEW]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    new = [c for c in NEW if with_text or c != "decoded_text"]
    schema = StructType([*rows.schema.fields[: len(keep)], *[StructField(c, NEW[c]) for c in new]])
    return rows.mapInArrow(lambda it: _encode(it, model, len(keep), with_text), schema)
