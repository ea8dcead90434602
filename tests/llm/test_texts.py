"""Operators on documents against brute force and the libraries they must equal."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lakefold.llm import jaccard, lm, packing, piece, quality, substring, tokenbin, toxicity
from lakefold.llm._cluster import components, most_frequent, new_folder

PIECE, WORD, BYTE = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))
LEAST = -(1 << 63)


def words(text):
    return (text or "").encode().split()


def test_substring_by_brute_force(docs, rows, no_docs):
    from pyspark.sql.types import LongType

    hashes = {(r["doc_id"], r["text"]): r["h"] for r in docs.select("doc_id", "text", F.hash("doc_id", "text").alias("h")).collect()}
    order = sorted({(LEAST if d is None else d, hashes[d, t], t or "") for d, t, *_ in rows if t})
    seen, expected = {}, {}
    for place, (d, _, t) in enumerate(order):
        w = words(t)
        gone = np.zeros(len(w) + 1, int)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (place, k)) != (place, k):
                gone[k] += 1
                gone[k + 20] -= 1
        left = [x for x, g in zip(w, np.cumsum(gone)[:-1], strict=True) if not g]
        expected[d, t] = b" ".join(left)
    out = substring.dedup_substrings(docs.withColumn("copy", F.col("text")), batch_bytes=3000, bucket_bytes=2000).collect()
    assert len(out) == len(rows)
    for r in out:
        t = r["copy"] or ""
        body = expected.get((LEAST if r["doc_id"] is None else r["doc_id"], t), b"")
        assert r["kept_text"].encode() == body and r["kept_sha256"] == hashlib.sha256(body).hexdigest()
        assert (r["n_words"], r["n_removed"]) == (len(words(t)), len(words(t)) - len(body.split()))
    empty = substring.dedup_substrings(no_docs)
    assert empty.count() == 0 and isinstance(empty.schema["n_words"].dataType, LongType)


def spans_in_process(texts, most, buckets):
    """Covered words (document, number), by way of the blobs of one task and their buckets."""
    import pyarrow as pa

    records = pa.RecordBatch.from_pydict({"d": list(range(len(texts))), "h": [0] * len(texts), "text": texts})
    blobs = [x for b in substring._pack(iter([records]), buckets, 20, 3, most) for x in zip(b["bucket"].to_pylist(), b["data"].to_pylist(), strict=True)]
    blobs.sort(key=lambda x: x[0])
    dealt = pa.RecordBatch.from_arrays([pa.array([x for x, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["bucket", "data"])
    return {(d, k) for b in substring._sort(iter([dealt]), 20) for d, a, z in zip(*(b[c].to_pylist() for c in ("d", "first", "last")), strict=True) for k in range(a, z)}


@pytest.mark.parametrize("hashes", [1 << 63, 40])
def test_substring_in_slices(monkeypatch, hashes):
    rnd = random.Random(3)
    passages = [" ".join(rnd.choice("a bc é 日本 x.y 12".split()) for _ in range(45)) for _ in range(6)]
    texts = ["\n ".join([" ".join(str(rnd.randrange(99)) for _ in range(rnd.randrange(60))), *rnd.sample(passages, rnd.randrange(3))]) for _ in range(70)] + ["", " ", " ".join(passages * 9)]
    runs = substring.T.hash_runs
    monkeypatch.setattr(substring, "SLICE_BYTES", 400)
    monkeypatch.setattr(substring, "COMPARED", 7)
    monkeypatch.setattr(substring.T, "hash_runs", lambda x, n: runs(x, n) % np.uint64(hashes))  # few: other words with one hash
    seen, expected = {}, set()
    for d, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (d, k)) != (d, k):
                expected |= {(d, x) for x in range(k, k + 20)}
    assert expected
    for most in (300, 2500, 1 << 20):
        assert spans_in_process(texts, most, 3) == expected


@pytest.mark.parametrize("documents", [1, 2000])
def test_substring_memory_of_a_batch(documents):
    import tracemalloc

    import pyarrow as pa

    # six MB in short words: one batch of the map, and one bucket
    ids = np.random.default_rng(5).integers(0, 90_000, 1_300_000 // documents * documents).reshape(documents, -1)
    records = pa.RecordBatch.from_pydict({"d": list(range(documents)), "h": [0] * documents, "text": [" ".join(map(str, x)) for x in ids.tolist()]})
    peaks = []
    tracemalloc.start()
    try:
        blobs = [x for b in substring._pack(iter([records]), 1, 20, 3, substring.BATCH_BYTES) for x in b["data"]]
        peaks.append(tracemalloc.get_traced_memory()[1] / records["text"].nbytes)
        tracemalloc.reset_peak()
        substring._count([x.as_buffer() for x in blobs], 20)
        peaks.append(tracemalloc.get_traced_memory()[1] / records["text"].nbytes)
    finally:
        tracemalloc.stop()
    assert max(peaks) < 16, peaks


def test_token_files_round_trip(spark, docs, rows, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORD)
    folder = new_folder(spark, "ids")
    manifest = tokenbin.write_ids(docs, folder, WORD, 1)
    read = tokenbin.read_ids(spark, folder).collect()
    ids = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    expected = Counter((d, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for d, t, *_ in rows)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read) == expected
    read.sort(key=lambda r: r["start"])
    assert [r["start"] for r in read] == np.cumsum([0, *[r["n_tokens"] for r in read]])[:-1].tolist()
    assert [LEAST if r["doc_id"] is None else r["doc_id"] for r in read] == sorted(LEAST if d is None else d for d, *_ in rows)
    part = manifest["parts"][0]
    assert len(tokenbin.open_part(folder, "ids", part["part"], "<u2")) == part["n_ids"]
    folder = new_folder(spark, "ids")
    tokenbin.write_ids(no_docs, folder, WORD, 1)
    assert tokenbin.read_ids(spark, folder).count() == 0


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(WORD), tokenbin.unit_encoder(WORD, 2)
    rnd = np.random.default_rng(1)
    alphabets = ("ab 'sStT.,!?\t\n0É", "ΣσςİIıßſŉ K.;Aéá ", "日本<|endoftext|> a\xa0", "aZ'SmMdÄßÿŒ×÷_#&09\r ", "a\x00\x1c\x0b\x85 ʼnˈa", "aé\u0301\u0308 oª²½", "aé, .!\n")
    for alphabet in alphabets:
        for _ in range(400):
            t = "".join(rnd.choice(list(alphabet), rnd.integers(0, 25)))
            assert np.frombuffer(b"".join(enc(tokenbin.units_of(t))), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, t
    for t in ("a<|endoftext|>b", "<|startoftext|> x", "<|endoftext|" + "y" * 200, "it's 'll they've I'd x'SS ''s", "z!!, y., x. w"):
        assert np.frombuffer(b"".join(enc(tokenbin.units_of(t))), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_units_are_encoded_once_while_they_fit():
    met = []
    enc = tokenbin.UnitEncoder(lambda u: met.append(u) or u + b"!", lambda words: [w.encode() for w in words], limit=2000)
    few = [b"a", b"b", b"a", b"x" * 100]
    assert b"".join(enc(few)) == b"a!b!a!" + b"x" * 100 + b"!" and b"".join(enc([b"a", b"b"])) == b"a!b!" and met == [b"a", b"b", b"x" * 100]
    many = [str(k % 50).encode() for k in range(1000)]
    assert list(enc(many)) == [u + b"!" for u in many] and enc.seen.held <= 2000 and len(enc.seen) + len(enc.seen.old) <= 16
    assert list(enc(["日", "本"])) == ["日".encode(), "本".encode()] and list(enc([])) == []
    assert enc.forget() and not enc.forget() and not enc.seen.old


def test_pieces_equal_the_library(docs, rows, no_docs):
    enc = piece.encoder(PIECE)
    rnd = np.random.default_rng(2)
    texts = ["".join(rnd.choice(list("  ▁abcthein\n\t0é日😀<s>́\0"), rnd.integers(0, 40))) for _ in range(1500)]
    texts += ["", " ", " " * 37, "x" * 5000, "the " * 3000]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == enc.library.encode(texts)
    for key, ok in list(enc.fits.items())[:3000]:
        a, b = key >> 32, key & 0xFFFFFFFF
        own = [enc.text[b]] if a < 0 else [enc.text[a], enc.text[b]]
        assert (enc.merged("".join(own)) == own) == ok
    found = piece.encode_pieces(docs.withColumn("copy", F.col("text")), PIECE).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = enc.library.encode(r["copy"] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_text"] == enc.library.decode(ids)
    assert piece.encode_pieces(no_docs, PIECE).count() == 0


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_jaccard_by_brute_force(docs, rows, no_docs, n, num, den):
    from fractions import Fraction

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()

    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(i)] = root(j)
    expected = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        expected.append((d, len(sets[i]), min(ids) if ids and sets[i] else d))
    found = jaccard.near_classes(docs, n, Fraction(num, den)).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    if n == 3:
        assert jaccard.near_classes(no_docs).count() == 0
        assert jaccard.one_of_each(docs).count() < len(rows)


def rows_of_joins(spark, after: int = -1) -> tuple[int, int]:
    """The most rows that a join has made in the queries after one, and the last query's number."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    list_of = lambda x: [x.apply(k) for k in range(x.size())]
    most, last = 0, after
    for e in list_of(store.executionsList()):
        if e.executionId() <= after:
            continue
        last, values = max(last, e.executionId()), store.executionMetrics(e.executionId())
        for node in list_of(store.planGraph(e.executionId()).allNodes()):
            for m in list_of(node.metrics()) if "Join" in node.name() else []:
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most, last


def test_jaccard_of_large_groups_writes_no_pairs(spark, monkeypatch):
    from fractions import Fraction

    # copies share their first columns, but few are similar enough
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    rnd, texts = random.Random(5), []
    for name, size, edits in (("a", 150, (2, 3, 4, 5)), ("b", 60, (1,))):
        for k in range(300):
            body = [f"{name}{x}" for x in range(size)]
            for x in rnd.sample(range(5, size - 5, 3), rnd.choice(edits)):
                body[x] = f"own{k}{name}"
            texts.append(" ".join(body))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(words, texts)]
    root = list(range(len(texts)))
    near = [[j for j in range(len(texts)) if 5 * len(a & sets[j]) >= 4 * len(a | sets[j])] for a in sets]
    while (low := [min(root[j] for j in x) for x in near]) != root:
        root = low
    assert 50 < len(set(root[:300])) < 250 and len(set(root[300:])) > 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    df.count()
    _, last = rows_of_joins(spark)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_classes(df, 5, Fraction(4, 5)).collect()}
    assert [found[k] for k in range(len(texts))] == root
    made, _ = rows_of_joins(spark, last)
    assert made < 40 * len(texts), made


def test_quality_by_brute_force(docs, rows, no_docs):
    def base(t):
        w = words(t)
        runs = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {j for k in range(len(w) - 7) if runs[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            dup += bool(line.encode().split()) and line in seen
            seen.add(line)
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), dup, len(cover)

    found = quality.judge(docs.withColumn("copy", F.col("text")), PIECE, BYTE).collect()
    assert len(found) == len(rows)
    for r in found:
        counts = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert counts == base(r["copy"])
        assert r["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality.base_counts("a b c d e f g h\n" * 2 + "x")[3:] == (1, 16)
    assert quality.judge(no_docs, PIECE, BYTE).count() == 0


def test_quality_bands():
    cache = quality._measures(PIECE, BYTE)
    good = "The quick brown fox jumps over the lazy dog while many other animals watch from the edge of the old forest near here."
    noise = "\x01\x02\x7f\x03 " * 40
    assert quality.in_band(quality.fertility(good, words(good), cache), "en", quality.script_of(good))
    assert not quality.in_band(quality.fertility(noise, words(noise), cache), "en", "LATIN")
    assert quality.script_of("Привет мир") == "CYRILLIC" and quality.script_of("") == "OTHER"


def test_quality_rejects_junk_and_keeps_clean_text(spark):
    sf = "/root/testdata/sf0.01"
    labelled = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    found = [r for r in quality.judge(labelled, PIECE, BYTE).collect() if not r["base_failed"]]
    low, clean = ([r["kept"] for r in found if r["quality"] == k] for k in (0, 1))
    assert np.mean(low) < 0.1 and np.mean(clean) > 0.97

    rnd = random.Random(5)
    texts = {lang: max((r["text"] for r in found if r["quality"] == 1 and r["lang"] == lang and r["kept"]), key=len).split()[:600] for lang in ("en", "de", "fr", "es")}
    stuck = lambda w: " ".join(x + rnd.choice(["###", "***", "$$$", "%%%"]) for x in w)
    letters = lambda w: " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in w)
    signs = lambda w: " ".join("".join(rnd.choice("#*$%&+=~^0123456789") for _ in range(6)) for _ in w)
    rows = [(kind, lang, make(w)) for lang, w in texts.items() for kind, make in (("clean", " ".join), ("stuck", stuck), ("table", " | ".join), ("letters", letters), ("signs", signs))]
    out = quality.judge(spark.createDataFrame(rows, "kind string, lang string, text string"), PIECE, BYTE).collect()
    assert not any(r["base_failed"] for r in out)
    assert {(r["kind"], r["lang"]) for r in out if r["kept"]} == {("clean", lang) for lang in texts}


def test_packing_invariants(docs, rows, no_docs):
    sizes = (16, 64, 256)
    out = packing.pack(docs.withColumn("copy", F.col("text")), capacities=sizes, group_rows=40).collect()
    bins: dict = {}
    total = Counter()
    for r in out:
        bins.setdefault(r["bin_id"], []).append(r)
        total[r["doc_id"]] += r["n_tokens"]
    expected = Counter()
    for d, t, *_ in rows:
        expected[d] += len(words(t)) + 1
    assert total == expected
    for some in bins.values():
        some.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in some] == np.cumsum([0, *[r["n_tokens"] for r in some]])[:-1].tolist()
        held = sum(r["n_tokens"] for r in some)
        assert {r["bin_tokens"] for r in some} == {held} and {r["bin_capacity"] for r in some} == {min(c for c in sizes if c >= held)}
    assert packing.pack(no_docs).count() == 0


def test_best_fit_by_brute_force():
    rnd = np.random.default_rng(3)
    lengths = rnd.integers(1, 65, 300)
    bins, offsets, capacity, held = packing.best_fit(lengths, (16, 32, 64))
    room, own, left = [], np.empty(300, int), int(lengths.sum())
    for i in np.argsort(-lengths, kind="stable"):
        n = lengths[i]
        fit = [k for k, x in enumerate(room) if x >= n]
        if fit:
            k = min(fit, key=lambda k: room[k])
        else:
            size = min((c for c in (16, 32, 64) if c >= n), key=lambda c: (packing.cost(c) / min(c, left), c))
            room.append(size)
            k = len(room) - 1
        room[k] -= n
        own[i] = k
        left -= n
    assert len(room) == len(capacity) and sorted(np.bincount(own, lengths)) == sorted(np.bincount(bins, lengths))
    assert (held <= capacity).all() and lengths.sum() >= 0.9 * capacity.sum()


def test_best_fit_opens_larger_bins_for_uniform_lengths():
    lengths = np.random.default_rng(6).integers(129, 257, 1003)
    bins, offsets, capacity, held = packing.best_fit(lengths)
    assert np.array_equal(np.bincount(bins, lengths), held) and (held <= capacity).all()
    assert capacity.max() > 256 and held.sum() >= 0.9 * capacity.sum()
    # a bin opened for all that is left shrinks to what it holds
    few, _, small, inside = packing.best_fit(np.array([200] * 13 + [150] * 6))
    assert np.array_equal(np.bincount(few, [200] * 13 + [150] * 6), inside) and sum(map(packing.cost, small.tolist())) / inside.sum() < 1.5
    assert packing.best_fit(np.full(3, 300))[2].tolist() == [1024]


def test_factorisation_machine_learns_pairs(spark, docs, no_docs):
    rnd = np.random.default_rng(4)
    filler = [f"word{k}" for k in range(50)]
    rows = []
    for k in range(1500):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        body = [*rnd.choice(filler, 6), *["insult"] * a, *["group"] * b]
        rows.append((k, " ".join(body), int(a and b)))
    data = [(y, toxicity.term_ids(t)) for _, t, y in rows]
    model = toxicity.fit(data[:1000])
    scores = toxicity.predict(model, [t for _, t, _ in rows[1000:]])
    assert np.mean((scores >= 0.5) == np.array([y for _, _, y in rows[1000:]])) > 0.95
    # the sum over pairs, by definition
    t = toxicity.term_ids(rows[0][1])
    at = {int(x): k for k, x in enumerate(model["terms"])}
    known = [at[int(x)] for x in t if int(x) in at]
    z = model["bias"] + model["w"][known].sum() + sum(model["v"][i] @ model["v"][j] for n, i in enumerate(known) for j in known[:n])
    assert toxicity.predict(model, [rows[0][1]])[0] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-4)
    out = toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    none = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity.train(docs, none)["w"].size == 0 and toxicity.score(no_docs, model).count() == 0


def test_language_model(spark, docs, rows, no_docs):
    learn = F.expr("coalesce(doc_id, 0) % 4 <> 0")
    out = lm.score_documents(docs, learn).collect()
    assert len(out) == len(rows)
    low = lambda t: (t or "").encode().lower().split()
    counts = Counter(w for d, t, *_ in rows if (d or 0) % 4 for w in [*low(t), None])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for d, t, *_ in rows:
        w = [*low(t), None]
        expected[d, len(w), sum(x in counts for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == expected
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lm.score_documents(no_docs, learn).count() == 0


def test_language_model_trains_on_every_row(spark, docs, rows, monkeypatch):
    seen = []
    average = lm._average

    def spy(batches):
        batches = list(batches)
        seen.extend(n for b in batches for n in b["n"].to_pylist())
        return average(iter(batches))

    monkeypatch.setattr(lm, "_average", spy)
    some = docs.where("length(text) < 5000 or text is null")
    out = lm.score_documents(some, F.expr("coalesce(doc_id, 0) % 4 <> 0")).first()
    expected = sum(len(words(t)) + 1 for d, t, *_ in rows if (d or 0) % 4 and len(t or "") < 5000)
    assert sum(seen) == expected == out["train_tokens"]


def test_network_gradients_and_windows():
    rnd = np.random.default_rng(0)
    net = lm.Gru(np.array([9, 8, 5, 4, 3, 2, 2, 1, 3.0]), hidden=4, classes=3)
    for k in net.w:
        net.w[k] = net.w[k] + rnd.normal(0, 0.3, net.w[k].shape)
    inputs, targets, mask, h = rnd.integers(0, 9, (5, 3)), rnd.integers(0, 9, (5, 3)), rnd.random((5, 3)) < 0.8, rnd.normal(0, 0.5, (3, 4))
    _, grads, _ = net.gradients(inputs, targets, mask, h)
    for k in net.w:
        flat = net.w[k].reshape(-1)
        for j in rnd.integers(0, flat.size, 5):
            old = flat[j]
            flat[j] = old + 1e-4
            up = net.gradients(inputs, targets, mask, h)[0]
            flat[j] = old - 1e-4
            down = net.gradients(inputs, targets, mask, h)[0]
            flat[j] = old
            assert (up - down) / 2e-4 * mask.sum() == pytest.approx(float(np.asarray(grads[k]).reshape(-1)[j]), abs=5e-3, rel=2e-2)
    # all tokens' probabilities sum to one, and lanes or window lengths don't change a score
    states = rnd.normal(0, 1, (1, 4)).repeat(9, 0)
    assert np.exp(net.log_probs(states, np.arange(9))[0]).sum() == pytest.approx(1, abs=1e-6)
    some = [rnd.integers(0, 8, k).astype(np.int32) for k in (0, 1, 7, 90, 33)]
    assert net.score(some, 2, 5) == pytest.approx(net.score(some, 5, 64), rel=1e-5)


def test_one_long_document_is_scored_in_few_windows(monkeypatch):
    rnd = np.random.default_rng(4)
    net = lm.Gru(np.array([9, 8, 5, 4, 3, 2, 2, 1, 3.0]), hidden=4, classes=3)
    for k in net.w:
        net.w[k] = (net.w[k] + rnd.normal(0, 0.3, net.w[k].shape)).astype(np.float32)
    docs = [rnd.integers(0, 8, n) for n in (20_000, *rnd.integers(0, 60, 40))]
    alone = [net.score([d], lanes=1, steps=50)[0] for d in docs]
    windows, log_probs = [], net.log_probs
    monkeypatch.setattr(net, "log_probs", lambda *x: windows.append(1) or log_probs(*x))
    assert np.allclose(net.score(docs), alone, rtol=1e-5) and len(windows) < 100


@pytest.mark.parametrize("scale", [1, 300])
def test_softmax_of_large_weights(scale):
    rnd = np.random.default_rng(6)
    net = lm.Gru(np.array([9, 8, 5, 4, 3, 2, 2, 1, 3.0]), hidden=4, classes=3)
    for k in ("wc", "wo"):
        net.w[k] = rnd.normal(0, scale, net.w[k].shape).astype(np.float32)
    states, targets = rnd.uniform(-1, 1, (50, 4)).astype(np.float32), rnd.integers(0, 9, 50)

    def log_softmax(x):
        x = x.astype(np.float64) - x.max()
        return x - np.log(np.exp(x).sum())

    expected = []
    for s, y in zip(states, targets, strict=True):
        k, at = net.of[y], slice(*net.begin[[net.of[y], net.of[y] + 1]])
        expected.append(log_softmax(s @ net.w["wc"] + net.w["bc"])[k] + log_softmax(net.w["wo"][at] @ s + net.w["bo"][at])[net.place[y] - net.begin[k]])
    assert np.allclose(net.log_probs(states, targets)[0], expected, rtol=1e-4, atol=1e-4)


def test_segments_teach_each_token_once():
    docs = [np.arange(k) for k in (0, 1, 3, 4, 5, 12, 13)]
    parts, goes_on, cut = lm.segments(docs, 4)
    learnt = [[*(p[1:] if g else p), *([] if c else ["end"])] for p, g, c in zip(parts, goes_on, cut, strict=True)]
    assert [x for p in learnt for x in p] == [x for d in docs for x in (*d, "end")]
    assert all(p[0] == q[-1] for q, p, g in zip(parts, parts[1:], goes_on[1:], strict=False) if g)


def test_held_out_text_is_likelier_than_by_counts(spark):
    from lakefold.llm import queries

    rows = queries.op2_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert rows["s"] > rows["b"] + 0.01 * rows["n"]


def test_toxicity_of_held_out_rows(spark):
    from lakefold.llm import queries

    sf = "/root/testdata/sf0.01"
    found = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    bad, good = ([r["score"] for r in found if r["toxic"] == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.75
    assert np.mean([r["toxic"] for r in found if r["predicted"]]) > 0.7


def test_repeated_ids_and_labels_train_once(spark):
    docs = spark.createDataFrame([(k % 40, f"word{k % 40 % 2} filler{k % 7}") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] * 3, "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model["terms"]) and toxicity.predict(model, ["word1"])[0] > toxicity.predict(model, ["word0"])[0]


def test_blocked_product_by_brute_force():
    rnd = np.random.default_rng(8)
    sets = [np.unique(rnd.integers(0, 300, k)).astype(np.uint64) for k in (0, 1, 50, 200, 200, 7)] + [np.arange(5, dtype=np.uint64)] * 2
    expected = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for width in (3, 64, 4096):
        got = jaccard.product(sets, width)
        np.fill_diagonal(got, 0)
        assert (got == np.array(expected) - np.diag(np.diag(expected))).all()


def test_components(spark):
    rnd = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rnd.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(300, 360)] + [(5, 5), (None, 1)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    for block in (7, 60, 10_000):
        found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), block=block).collect()}
        assert found == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_most_frequent(spark):
    df = spark.createDataFrame([(k, 1 + k * k) for k in range(100)], "w long, n long")
    kept = {r["w"] for r in most_frequent(df, "n", 30).collect()}
    assert 20 <= len(kept) <= 30 and kept == set(range(100 - len(kept), 100))


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op3_chat_format", "op6_jaccard_join", "op9_embedding_near_dedup"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from lakefold.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    out = queries.QUERIES[name](spark, sf)
    cols = sorted(out.columns)
    found = con.sql(queries.ORACLE[name])
    assert sorted(found.columns) == cols
    rows = sorted(tuple(r[c] for c in cols) for r in out.collect())
    assert rows == sorted(found.project(", ".join(f'"{c}"' for c in cols)).fetchall())
