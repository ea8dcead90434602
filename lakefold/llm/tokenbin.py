"""Token ids as flat unsigned integer files with 64-bit document offsets.

A folder holds, per partition k, `ids-k.bin` (the ids of its documents one after another, little
endian, 2 or 4 bytes each), `docs-k.bin` (signed 64-bit document ids) and `offsets-k.bin` (unsigned
64-bit: where each document starts in ids-k.bin, and the end), and one `manifest.json` with, per
partition, its documents, its ids and its base: the prefix sum of the ids of the partitions before.
A document's global start is its partition's base plus its offset, so no file is written twice.

Partitions are ranges of (doc_id, hash of the text), so the order of the files is ascending doc_id,
null ids first (stored as the least 64-bit integer), ties by the text's hash. Null texts count as
empty: a document without ids still gets its end id. Equal rows are stored as often as they occur.
Files are written under a task attempt's own name and then renamed, so a repeated task leaves one copy.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._text import LONGEST, WordCache, forget, pieces, remembered

#: Text that one file is meant to hold.
FILE_BYTES = 256 << 20
NULL_ID = -(1 << 63)
#: Bytes of Latin-1 texts that the short way takes: what is printed of ASCII and its white space, and letters.
_KNOWN = bytes([9, 10, 13, *range(32, 127), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))])
_LOWER = bytes(ord(chr(c).lower()) if c < 0x80 or c in _KNOWN else c for c in range(256))
#: The vocabulary's units, in such bytes: its endings, letters in a row, single digits, other signs in a row.
_UNITS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z\xdf-\xf6\xf8-\xff0-9]+")
#: A sign between a letter and white space is a unit of its own.
_MARK = re.compile(rb"[.,;:!?](?=[ \n])(?<=[a-z\xdf-\xf6\xf8-\xff].)")

_ENCODERS: dict[tuple, UnitEncoder] = {}


class _Seen(dict):
    """Results of a function of one unit, remembered in two generations of `limit` bytes; a unit that is there costs a look-up alone."""

    def __init__(self, encode, limit: int):
        self.encode, self.limit, self.old, self.held = encode, limit, {}, 0

    def __missing__(self, unit: bytes) -> bytes:
        out = self.old.get(unit)
        if out is None:
            out = self.encode(unit)
        if len(unit) <= LONGEST:
            self.held += len(unit) + 250
            if self.held > self.limit:
                self.old, self.held = dict(self), len(unit) + 250
                self.clear()
            self[unit] = out
        return out


class UnitEncoder:
    """The ids' bytes of each of units_of() one text: Latin-1 units one by one, other words in the library's batches."""

    def __init__(self, short, encode, limit: int = 64 << 20):
        self.seen, self.words = _Seen(short, limit), WordCache(encode, limit)
        remembered(self)

    def __call__(self, units: list) -> Iterable[bytes]:
        return self.words(units) if units and isinstance(units[0], str) else map(self.seen.__getitem__, units)

    def forget(self) -> bool:
        """Whether there was anything to forget; the words are forgotten apart."""
        held = bool(self.seen)
        self.seen.clear()
        self.seen.old, self.seen.held = {}, 0
        return held


def unit_encoder(path: str, width: int) -> UnitEncoder:
    """Maps units_of() texts to their ids' bytes with the tokenizers library; one per worker process.

    The vocabulary's rules lower letters, drop white space, never join text across it, and part letters
    from the signs after them, so a text's ids are its units' ids in a row.
    """
    if (path, width) not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tok = Tokenizer.from_file(path)
        tokenize, kind = tok.model.tokenize, {2: "H", 4: "I"}[width]
        # the library's spelling of each character's bytes
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelling = {c: level.pre_tokenize_str(chr(c))[0][0] for c in _KNOWN if c > 32}
        assert all(spelling[c] == chr(c) for c in _KNOWN if 32 < c < 127)

        def short(word: bytes) -> bytes:
            """Unit by unit, without the steps that leave known bytes in lower case as they are."""
            if word.isalpha():
                return array(kind, [t.id for t in tokenize(word.decode())]).tobytes()
            units = [u.decode("latin-1") for u in _UNITS.findall(word)]
            if not word.isascii():
                units = [u.translate(spelling) for u in units]
            return array(kind, [t.id for u in units for t in tokenize(u)]).tobytes()

        def encode(words: list[str]) -> list[bytes]:
            return [array(kind, x.ids).tobytes() for x in tok.encode_batch_fast(words, add_special_tokens=False)]

        _ENCODERS[path, width] = UnitEncoder(short, encode)
    return _ENCODERS[path, width]


def units_of(text: str) -> list:
    """Parts whose ids, one after another, are the text's: words, and signs at their ends.

    Latin-1 bytes in lower case where all characters are known to lower alone; else the words as they are.
    """
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        raw = b"\0"
    if raw.translate(None, _KNOWN) or b"<|" in raw:  # the library takes special tokens out of any text
        return [w.decode() for w in text.encode().split()]
    return _MARK.sub(rb" \g<0>", raw.translate(_LOWER)).split()


def id_width(path: str) -> int:
    """Bytes an id needs."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _fs(folder: str):
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder) if not folder.startswith("file:") else "file://" + folder[5:])


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text, cut at white space, and whether it is the last."""
    if len(text) < 1 << 20:
        yield text, True
        return
    parts = [x.decode() for x in pieces(text.encode())]
    yield from ((x, k == len(parts) - 1) for k, x in enumerate(parts))


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end_id: int, width: int) -> Iterator[pa.RecordBatch]:
    encode = unit_encoder(path, width)
    forget(encode, encode.words)
    end = end_id.to_bytes(width, "little")
    fs, root = _fs(folder)
    part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
    name = f"{part:06d}.bin"
    docs, sizes, held = [np.empty(0, np.int64)], [], 0
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/.ids-{attempt}") as out:
        for records in batches:
            # long texts come in pieces, so what is held is bounded; the end follows the last one
            for x, last in (p for t in records["text"] for p in _pieces(t.as_py() or "")):
                body = b"".join(encode(units_of(x))) + (end if last else b"")
                held += len(body)
                out.write(body)
                if last:
                    sizes.append(held // width)
                    held = 0
            docs.append(records["d"].to_numpy())
    offsets = np.cumsum([0, *sizes]).astype("<u8")
    for kind, data in (("docs", np.concatenate(docs).astype("<i8")), ("offsets", offsets)):
        with fs.open_output_stream(f"{root}/.{kind}-{attempt}") as out:
            out.write(data.tobytes())
    for kind in ("ids", "docs", "offsets"):
        fs.move(f"{root}/.{kind}-{attempt}", f"{root}/{kind}-{name}")
    yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(sizes)], "n_ids": [int(offsets[-1])]})


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> dict:
    """Encode docs into folder (readable by all executors) and return the manifest. An empty table gives a manifest without partitions."""
    width = id_width(tokenizer)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("d"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(1, math.ceil(size / file_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    done = rows.repartitionByRange(parts, "d", "h").sortWithinPartitions("d", "h", "text").select("d", "text").mapInArrow(lambda it: _write(it, folder, tokenizer, end_id, width), "part long, n_docs long, n_ids long")
    found = sorted(tuple(x) for x in done.collect())
    manifest = {"width": width, "end_id": end_id, "parts": []}
    base = first = 0
    for part, n_docs, n_ids in found:
        if n_docs:
            manifest["parts"].append({"part": part, "n_docs": n_docs, "n_ids": n_ids, "base": base, "first_doc": first})
            base, first = base + n_ids, first + n_docs
    fs, root = _fs(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def read_manifest(folder: str) -> dict:
    fs, root = _fs(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def open_part(folder: str, kind: str, part: int, dtype: str):
    """A part's numbers, memory-mapped where the store is a file system of this machine."""
    fs, root = _fs(folder)
    name = f"{root}/{kind}-{part:06d}.bin"
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, dtype, mode="r") if os.path.getsize(name) else np.empty(0, dtype)
    with fs.open_input_stream(name) as f:
        return np.frombuffer(f.read(), dtype)


def _read(batches: Iterator[pa.RecordBatch], folder: str, parts: list[dict], width: int) -> Iterator[pa.RecordBatch]:
    for records in batches:
        for k in records["id"].to_pylist():
            ids = open_part(folder, "ids", parts[k]["part"], f"<u{width}")
            docs = open_part(folder, "docs", parts[k]["part"], "<i8")
            offsets = open_part(folder, "offsets", parts[k]["part"], "<u8").astype(np.int64)
            for a in range(0, len(docs), 4096):
                cut = offsets[a : a + 4097]
                raw = [ids[x:y].astype("<u4").tobytes() for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                some = docs[a : a + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64(), mask=some == NULL_ID), pa.array(cut[:-1] + parts[k]["base"], pa.int64()), pa.array(np.diff(cut), pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the folder: doc_id, start, n_tokens and the crc32 of its ids as 32-bit integers, in one task a file."""
    manifest = read_manifest(folder)
    parts, width = manifest["parts"], manifest["width"]
    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(lambda it: _read(it, folder, parts, width), "doc_id long, start long, n_tokens long, ids_crc32 long")
