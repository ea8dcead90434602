"""Quality rules: counts of words, symbols and repeats, and tokeniser fertility.

Base rules count, in a whole text, words (n_words) and their code points (word_chars), symbol
characters (n_symbols), lines equal to an earlier one (n_dup_lines) and words in 8-word windows
that occur twice or more (n_repeat_words). A text fails with fewer than 20 words, or with more than
30 percent of its words in repeated windows.

The method's verdict measures how two public vocabularies, a byte-level and a piece vocabulary with
byte fallback, see the text: characters per token of each, the share of byte-fallback tokens, and
the entropy of the piece tokens against what that many tokens can reach. Bands are by script, the one
of most letters; these are wide, and random bytes, broken encodings and texts made of a few words fall
outside. Languages given by name also have least values measured on clean text: what symbols stuck to
words, tables or random letters do to a text's tokens is far more than clean texts of its length
differ by. A text passes if every measure is in its band.

Null, empty and wordless texts have zero counts and fail. Null or unknown languages use the script's
band. Text without letters is judged by its language's band, else as Latin. Words are remembered per
worker process, so the cost is per distinct word.
"""

from __future__ import annotations

import base64
import contextlib
import math
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from . import _text as T

LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

#: Per script: least and most characters per piece token, least per byte-level token, most byte fallback, least entropy share.
BANDS = {
    "LATIN": (1.3, 8.0, 1.0, 0.10, 0.35),
    "CYRILLIC": (1.2, 8.0, 0.4, 0.10, 0.35),
    "GREEK": (0.6, 6.0, 0.4, 0.30, 0.35),
    "CJK": (0.3, 4.0, 0.3, 0.60, 0.30),
    "OTHER": (0.2, 8.0, 0.2, 0.90, 0.30),
}
#: Per language of Latin script: mean and spread, over single tokens, of characters per piece token and per byte-level
#: token; entropy share as a line in log2 of the tokens, and its spread; mean and spread of the first measure over the
#: second. From the texts of sf0.1 labelled as of good quality.
LANGUAGES = {
    "en": (2.218, 0.89, 2.244, 0.91, 1.199, -0.0523, 0.0099, 0.989, 0.25),
    "de": (2.241, 0.96, 2.038, 0.86, 1.204, -0.0545, 0.0099, 1.100, 0.39),
    "fr": (1.981, 0.97, 1.849, 0.96, 1.191, -0.0537, 0.0109, 1.071, 0.36),
    "es": (1.941, 0.97, 1.770, 0.84, 1.180, -0.0516, 0.0133, 1.097, 0.36),
}
#: Spreads below the mean at which a language's band ends, and the most byte fallback there.
SPREADS, LANGUAGE_FALLBACK = 3.5, 0.08
SCRIPTS = {"LATIN": "LATIN", "CYRILLIC": "CYRILLIC", "GREEK": "GREEK", "CJK": "CJK", "HIRAGANA": "CJK", "KATAKANA": "CJK", "HANGUL": "CJK"}

#: Of Latin-1: what is a letter but of no script by name, and what is no letter.
_ODD = bytes([0xAA, 0xB5, 0xBA])
_NOT_ODD = bytes(c for c in range(256) if c not in _ODD)
_NO_LETTER = bytes(c for c in range(256) if not chr(c).isalpha())

_CACHES: dict[tuple, T.WordCache] = {}
_SCRIPT: dict[str, str] = {}


def _measures(piece_path: str, byte_path: str) -> T.WordCache:
    """For words: piece ids as bytes, and the number of byte-level tokens."""
    key = piece_path, byte_path
    if key not in _CACHES:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def measure(words: list[bytes]) -> list[tuple[bytes, int]]:
            texts = [w.decode() for w in words]
            return [(array("I", ids).tobytes(), len(own.encode_ordinary(" " + t))) for t, ids in zip(texts, pieces.encode(texts, num_threads=1), strict=True)]

        _CACHES[key] = T.WordCache(measure, 72 << 20)
    return _CACHES[key]


def script_of(text: str) -> str:
    """The script of most letters among the distinct characters, weighted by their count."""
    with contextlib.suppress(UnicodeEncodeError):
        raw = text.encode("latin-1")
        if not raw.translate(None, _NOT_ODD):  # all its letters are Latin
            return "LATIN" if raw.translate(None, _NO_LETTER) else "OTHER"
    found: dict[str, int] = {}
    chars, counts = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_counts=True)
    for c, n in zip(chars.tolist(), counts.tolist(), strict=True):
        kind = _SCRIPT.get(c)
        if kind is None:
            c_ = chr(c)
            kind = _SCRIPT[c] = SCRIPTS.get(unicodedata.name(c_, "OTHER").split()[0], "OTHER") if c_.isalpha() else ""
        if kind:
            found[kind] = found.get(kind, 0) + n
    return max(sorted(found), key=found.get) if found else "OTHER"


def letters_of(text: str) -> str:
    """The text's script, or "" if it has no letter."""
    script = script_of(text)
    return script if script != "OTHER" or any(map(str.isalpha, text)) else ""


def repeated_words(buf: bytes, starts: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more in the text."""
    runs = T.hash_runs(T.hash_words(buf, starts, ends), window)
    if len(runs) < 2:
        return 0
    by = np.argsort(runs, kind="stable")
    same = runs[by][1:] == runs[by][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[by[1:][same]] = True
    twice[by[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    at = np.flatnonzero(twice)
    cover[at] += 1
    cover[at + window] -= 1
    return int((np.cumsum(cover[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    buf = text.encode()
    starts, ends = T.words_of(buf)
    raw = np.frombuffer(buf, np.uint8)
    dup, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.strip(" \t\n\r\x0b\x0c"))
        else:
            seen.add(line)
    return len(starts), len(text) - int(T.SPACE[raw].sum()), int(SYMBOL[raw].sum()), dup, repeated_words(buf, starts, ends)


def fertility(text: str, words: list[bytes], cache: T.WordCache) -> tuple[float, float, float, float]:
    """Characters per piece token and per byte-level token, share of byte fallback, entropy as a share of the greatest possible."""
    found = cache(words)
    ids = np.frombuffer(b"".join([x[0] for x in found]), "<u4")
    if not len(ids):
        return 0.0, 0.0, 0.0, 0.0
    chars = sum(map(len, words)) if text.isascii() else len(b" ".join(words).decode()) - len(words) + 1
    _, n = np.unique(ids, return_counts=True)
    p = n / len(ids)
    most = np.log2(min(len(ids), 4096))
    entropy = float(-(p * np.log2(p)).sum() / most) if most else 1.0
    return chars / len(ids), chars / max(1, sum(x[1] for x in found)), float(((ids >= 3) & (ids < 259)).mean()), entropy


def in_band(values: tuple[float, float, float, float], lang: str | None, script: str, tokens: float = 4096) -> bool:
    """Whether measures of a text of so many piece tokens pass; script "" is text without letters."""
    least, most, least_bytes, fallback, entropy = BANDS[script or "LATIN"]
    if script in ("LATIN", "") and lang in LANGUAGES:
        piece, piece_spread, own, own_spread, start, slope, entropy_spread, ratio, ratio_spread = LANGUAGES[lang]
        root, usual = math.sqrt(max(1, tokens)), start + slope * math.log2(max(1, tokens))
        wide = SPREADS / root
        # entropy and the vocabularies' ratio fall together where the same few symbols stand between words; text of
        # longer tokens than the measured ones is another kind, with another ratio
        both = (values[3] - usual) / entropy_spread + (values[0] / max(values[1], 1e-9) - ratio) * root / ratio_spread
        if both < -SPREADS * math.sqrt(2) and values[0] <= piece + wide * piece_spread:
            return False
        least, least_bytes = max(least, piece - wide * piece_spread), max(least_bytes, own - wide * own_spread)
        fallback = LANGUAGE_FALLBACK
        entropy = max(entropy, usual - SPREADS * entropy_spread)
    return least <= values[0] <= most and least_bytes <= values[1] and values[2] <= fallback and values[3] >= entropy


NEW = {"n_words": LongType(), "word_chars": LongType(), "n_symbols": LongType(), "n_dup_lines": LongType(), "n_repeat_words": LongType(), "base_failed": BooleanType(), "kept": BooleanType(), "chars_per_token": DoubleType(), "chars_per_byte_token": DoubleType(), "fallback_share": DoubleType(), "entropy_share": DoubleType()}


def _judge(batches: Iterator[pa.RecordBatch], piece_path: str, byte_path: str, at: int) -> Iterator[pa.RecordBatch]:
    cache = _measures(piece_path, byte_path)
    T.forget(cache)
    for records in batches:
        rows = []
        for text, lang in zip(records["_text"].to_pylist(), records["_lang"].to_pylist(), strict=True):
            text = text or ""
            counts = base_counts(text)
            failed = counts[0] < LEAST_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
            values = fertility(text, text.encode().split(), cache)
            kept = not failed and in_band(values, lang, letters_of(text), counts[1] / values[0])
            rows.append((*counts, failed, kept, *values))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 4
        new = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*records.columns[:at], *new], names=[*records.schema.names[:at], *NEW])


def judge(docs: DataFrame, piece_model: str, byte_ranks: str, text_col: str = "text", lang_col: str | None = "lang", keep: list[str] | None = None) -> DataFrame:
    """docs' columns `keep` (all by default) with the base counts, base_failed, kept and the measures.

    A column of docs with a new column's name is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NEW]
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(*keep, F.col(text_col).alias("_text"), lang.alias("_lang"))
    schema = StructType([*rows.schema.fields[: len(keep)], *[StructField(c, k) for c, k in NEW.items()]])
    return rows.mapInArrow(lambda it: _judge(it, piece_model, byte_ranks, len(keep)), schema)
