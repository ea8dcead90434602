"""Chats, vectors, and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakefold.llm import chat, embed


def conversations():
    rnd = random.Random(3)
    words = ["w", "<|im_end|>\n", "<\\\\|", "<", "|", "\\", "", "é😀", "$1", "<|im_start|>assistant\nno"]
    rows = []
    for c in (1, 2, None, 4, 5):
        for k in range(rnd.randint(1, 60)):
            role = rnd.choice(["user", "assistant", "assistant", "a\n%0Ab<|x", None]) if k or c == 2 else "system"
            rows.append((c, k, role, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) if rnd.random() < 0.95 else None, "extra"))
    rows.append((5, None, "assistant", "early", "extra"))
    return rows


@pytest.mark.parametrize(("budget", "history"), [(16, 2), (40, 0), (64, 3), (4000, 2)])
def test_chat_reads_back(spark, budget, history):
    rows = conversations()
    df = spark.createDataFrame(rows + [rows[0]], "conv_id long, turn long, role string, text string, window string")
    windows = chat.format_windows(df, budget, history).cache()
    found = {r["conv_id"]: r for r in chat.read_windows(windows).collect()}
    for c in (1, 2, None, 4, 5):
        turns = sorted([((-1 if r[1] is None else r[1]), r[2] or "", r[3] or "") for r in rows + [rows[0]] if r[0] == c])
        body = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        assert found[c]["n_turns"] == len(turns) and found[c]["turns_sha256"] == hashlib.sha256(body.encode()).hexdigest()
        assert found[c]["loss_chars"] == len(loss) and found[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for w in windows.collect():
        assert w["text"].count(chat.START) == w["text"].count(chat.END)
        assert w["text"].count(chat.START) <= w["n_new"] + history + 1
        assert w["n_tokens"] <= budget or w["n_new"] == 1 or budget < 64
    assert windows.count() > 5 or budget > 64


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_windows(chat.format_windows(df)).count() == 0


def test_vectors_by_brute_force(spark):
    rnd = np.random.default_rng(1)
    rows, centre = [], rnd.normal(size=(6, 16))
    for k in range(300):
        v = centre[k % 6] + rnd.normal(0, 0.02 if k % 3 else 0.6, 16)
        rows.append((k, [float(np.float32(x)) for x in v], k % 2 if k % 11 else None, "extra"))
    rows += [(500, None, 1, ""), (501, [0.0] * 16, 1, ""), (502, [float("nan")] * 16, 1, ""), (503, [None] * 16, 1, ""), (504, [], 1, ""), (505, [1.0, 2.0], 1, ""), (506, [2.0, 4.0], 1, ""), rows[3], (None, rows[3][1], rows[3][2], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string")

    def unit(x):
        if not x or None in x or not np.isfinite(x).all() or not np.any(x):
            return None
        return np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64))

    units = [unit(r[1]) for r in rows]
    linked = [[u is not None and w is not None and len(u) == len(w) and rows[i][2] == rows[j][2] is not None and i != j and u @ w >= 0.98 for j, w in enumerate(units)] for i, u in enumerate(units)]
    links = [sum(x) for x in linked]
    found = embed.near_vectors(df, block=16).collect()
    assert len(found) == len(rows)
    total = sum(r["n_links"] for r in found)
    assert 0.95 * sum(links) <= total <= sum(links)
    most = {}
    for r, n in zip(rows, links, strict=True):
        most[r[0]] = max(n, most.get(r[0], 0))
    assert all(r["n_links"] <= most[r["vec_id"]] for r in found)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)
    assert {r["vec_id"]: r["component_id"] for r in found}[506] == 505
    assert embed.near_vectors(df.limit(0)).count() == 0


def test_hot_bucket_blocks_count_each_link_once(spark):
    rnd = np.random.default_rng(2)
    v = np.ones(8) + rnd.normal(0, 1e-3, (200, 8))
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    found = embed.near_vectors(df, block=32).collect()
    assert {r["n_links"] for r in found} == {199} and {r["component_id"] for r in found} == {0}


def test_every_window_of_the_query_counts(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    windows = chat.format_windows(turns).cache()
    assert windows.count() > 1.3 * turns.select("conv_id").distinct().count()
    masked = windows.select(F.aggregate("masked", F.lit(0).cast("long"), lambda a, m: a + m["length"]).alias("n")).agg(F.sum("n")).first()[0]
    written = turns.where("role = 'assistant'").agg(F.sum(F.char_length(chat.escape(F.col("text"))))).first()[0]
    assert masked == written and windows.where(F.col("n_new") < F.size(F.split("text", r"<\|im_start\|>")) - 1).count() > 0


def test_projections_follow_the_number_of_vectors():
    sizes = [embed.plan(n) for n in (10, 1000, 10**6, 10**9)]
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(sizes, sizes[1:], strict=False))
    for tables, projections in sizes:
        assert (1 - embed.share_a_step(0.98, embed.WIDTH) ** projections) ** tables <= embed.MISS


def test_pipeline(spark):
    import corpus_pipeline as P
    from pyspark.sql import Row

    from lakefold.llm import quality, toxicity

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"score": F.lit("own"), "kept": F.lit("own"), "n_words": F.lit(-1)}).limit(120)
    odd = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string"), "lang": F.lit(None).cast("string")})
    docs = spark.createDataFrame(docs.union(odd).union(docs.limit(1)).collect(), docs.schema).cache()
    words = lambda t: (t or "").encode().split()
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns and {r["score"] for r in out.select("score").collect()} == {"own"}, name
        before, after = docs.collect(), out.collect()
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            learn = {r["doc_id"]: r["text"] for r in before if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
            rows = sorted(((labels[d], toxicity.term_ids(x)) for d, x in learn.items()), key=lambda r: (r[0], r[1].astype("<i4").tobytes()))
            scores = toxicity.predict(toxicity.fit(rows), [r["text"] for r in before])
            expected = [r for r, s in zip(before, scores, strict=True) if s < P.TOXIC]
        elif name == "quality":
            kept = {(r["doc_id"], r["text"]): r["ok"] for r in quality.judge(docs.select("doc_id", "text", "lang"), P.PIECE_BPE, P.BYTE_BPE).select("doc_id", "text", F.col("kept").alias("ok")).collect()}
            expected = [r for r in before if kept[r["doc_id"], r["text"]]]
        elif name == "near_duplicates":
            sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (r["text"] or "").encode().lower().split()) else set() for r in before]
            root = list(range(len(before)))
            for _ in before:  # labels run along links until they rest
                for i, a in enumerate(sets):
                    for j, b in enumerate(sets):
                        if a and b and 5 * len(a & b) >= 4 * len(a | b):
                            root[i] = root[j] = min(root[i], root[j])
            least = {k: min(r["doc_id"] for r, x in zip(before, root, strict=True) if x == k) for k in set(root)}
            expected = [r for r, k in zip(before, root, strict=True) if r["doc_id"] == least[k]]
        else:
            seen, expected = {}, []
            for r in sorted(before, key=lambda r: r["doc_id"]):
                w, gone = words(r["text"]), set()
                for k in range(len(w) - 19):
                    if seen.setdefault(tuple(w[k : k + 20]), (r["doc_id"], k)) != (r["doc_id"], k):
                        gone |= set(range(k, k + 20))
                text = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
                expected.append(Row(**(r.asDict() | {"text": text, "n_chars": len(text)})))
        assert sorted(map(str, after)) == sorted(map(str, expected)), name
        assert 0 < len(after) <= len(before)
        docs = out
    packed = P.STAGES[-1][1](spark, docs, sf)
    total = Counter()
    for r in expected:
        total[r["doc_id"]] += len(words(r["text"])) + 1
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == total
