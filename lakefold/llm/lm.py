"""Language-model scores: a gated recurrent network in numpy beside a smoothed unigram model.

Tokens are a text's words with A-Z in lower case, then one end. The unigram model (base_score) counts
all training documents' tokens. The recurrent model predicts the VOCABULARY most frequent tokens, the
end, and one symbol for all other words; such a word's probability is the symbol's times its share
(smoothed as in the unigram model) of the other words. Output softmax is factored into classes of
about equal weight, so a token costs a class and its own class's members, not the vocabulary. Training
is truncated backpropagation: windows of STEPS tokens whose gradient stays inside, while the state goes
on to the next window, in lanes that hold one document after another (of a long one, SEGMENT tokens; it
goes on in other lanes, so that no lane outlasts the others). Scoring carries the state
through the whole document likewise, so a score is that of the complete text, however long.

Counts are exact over all training documents, and all of them train the network, in one task for each
TRAINER_TOKENS tokens. Each trains a copy from the same start on its part, as a stream; the copies are
averaged in two levels. So what training reads, and how many tasks read it, grows with the input. A task reads its part once, and again until it has
made LEAST_UPDATES updates, whatever the size of the input.
The CACHE most frequent words are sent to the tasks with their counts; all others are joined, together
with one row for each document, whose word (white space and a hash) meets none and spreads evenly.

Null and empty texts are the end alone. Null ids count as the empty text where ids choose training
rows. Rows equal in id and text get equal results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import _text as T
from ._cluster import checkpoint, most_frequent

VOCABULARY, CLASSES, HIDDEN, STEPS, LANES, RATE, SEED = 2000, 45, 24, 32, 512, 3e-2, 3
#: Tokens of a document that one lane learns from; a longer one goes on in other lanes.
SEGMENT = 2048
#: The training documents train the network in a task for each TRAINER_TOKENS tokens, TRAIN_TOKENS at a time.
TRAINER_TOKENS, TRAIN_TOKENS, LEAST_UPDATES = 8_000_000, 1_600_000, 100
CACHE, SCORE_LANES, LONGEST_WINDOW = 100_000, 512, 1024
#: exp of what is within, and sums of such, keep their precision.
SAFE = 60
#: The end's spelling: no word holds white space.
END = b"\n"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in x's own memory, by the hyperbolic tangent of its half, which no x overflows."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Gru:
    """The network's weights, forward and backward passes."""

    NAMES = ("x", "u", "b", "wc", "bc", "wo", "bo")

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES):
        """counts: of each token, by falling frequency; the last token is the end."""
        p = (counts + 1.0) / (counts + 1.0).sum()
        self.end, self.hidden, self.done = len(p) - 1, hidden, 0
        mass = np.cumsum(np.sqrt(np.sort(p)[::-1]))
        order = np.argsort(-p, kind="stable")
        number = np.minimum((mass / mass[-1] * classes).astype(np.int64), classes - 1)
        number = np.unique(number, return_inverse=True)[1]
        self.place = np.empty(len(p), np.int64)
        self.place[order] = np.arange(len(p))
        self.of = number[self.place]
        self.begin = np.searchsorted(number, np.arange(number[-1] + 2))
        rnd = np.random.default_rng(SEED)
        weight = np.add.reduceat(p[order], self.begin[:-1])
        small = lambda *s: rnd.normal(0, 0.1, s).astype(np.float32)
        self.w = {
            "x": small(len(p), 3 * hidden), "u": small(hidden, 3 * hidden), "b": np.zeros(hidden, np.float32),
            "wc": np.zeros((hidden, len(weight)), np.float32), "bc": np.log(weight).astype(np.float32),
            "wo": np.zeros((len(p), hidden), np.float32), "bo": np.log(p[order] / weight[number]).astype(np.float32),
        }

    def hidden_states(self, inputs: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (steps, lanes, hidden) after each step of inputs (steps, lanes), starting from h; an end resets the state.

        Inside, and in what keep gets, lanes lie along the rows, so that the gates' parts are whole blocks of memory.
        """
        w, n = self.w, self.hidden
        x, u, b = w["x"], np.ascontiguousarray(w["u"].T), w["b"][:, None]
        going, h = inputs != self.end, np.ascontiguousarray(h.T)
        out = np.empty((len(inputs), n, inputs.shape[1]), np.float32)
        for t in range(len(inputs)):
            if not going[t].all():
                h = h * going[t]
            gates, g = np.ascontiguousarray(x.take(inputs[t], 0).T), u @ h
            zr = logistic(gates[: 2 * n] + g[: 2 * n])
            z, r = zr[:n], zr[n:]
            a = g[2 * n :] + b
            c = r * a
            c += gates[2 * n :]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((h, z, r, a, c))
            h = np.subtract(h, c, out=out[t])
            h *= z
            h += c
        return np.ascontiguousarray(out.transpose(0, 2, 1)), np.ascontiguousarray(h.T)

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Log probability of each target after each state (rows); with grads, also the gradient by the states of its negative sum."""
        w = self.w
        # rows of one class side by side
        own = self.of[targets].astype(np.uint16)
        by = np.argsort(own, kind="stable")
        own, place, states = own[by], self.place[targets[by]], states[by]
        cuts, rows = np.searchsorted(own, np.arange(len(self.begin))), np.arange(len(by))
        logits = w["wc"].T @ states.T
        logits += w["bc"][:, None]
        # no state is beyond 1, so few weights are so large that exp needs its arguments shifted
        if (np.abs(w["wc"]).sum(0) + np.abs(w["bc"])).max() > SAFE:
            logits -= logits.max(0)
        most = np.maximum.reduceat(np.abs(w["wo"]).sum(1) + np.abs(w["bo"]), self.begin[:-1])
        held = logits[own, rows].astype(np.float64)
        p = np.exp(logits, out=logits)
        total = p.sum(0)
        held -= np.log(total)
        back = None
        if grads is not None:
            p /= total
            p[own, rows] -= 1
            grads["wc"], grads["bc"] = (p @ states).T, p.sum(1)
            back = p.T @ w["wc"].T
            grads["wo"], grads["bo"] = np.zeros_like(w["wo"]), np.zeros_like(w["bo"])
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = int(self.begin[k]), int(self.begin[k + 1])
            if b - a == 1:
                continue
            some = slice(int(cuts[k]), int(cuts[k + 1]))
            s, at = states[some], place[some] - a
            line, wo = rows[: len(at)], w["wo"][a:b]
            inner = wo @ s.T
            inner += w["bo"][a:b, None]
            if most[k] > SAFE:
                inner -= inner.max(0)
            held[some] += inner[at, line]
            q = np.exp(inner, out=inner)
            total = q.sum(0)
            held[some] -= np.log(total)
            if grads is not None:
                q /= total
                q[at, line] -= 1
                grads["wo"][a:b], grads["bo"][a:b] = q @ s, q.sum(1)
                back[some] += q.T @ wo
        out = np.empty_like(held)
        out[by] = held
        if back is not None:
            into = np.empty_like(back)
            into[by] = back
            back = into
        return out, back

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss per token, gradients, and the state after the window. The gradient ends at the window's start."""
        w, n, keep, grads = self.w, self.hidden, [], {}
        states, last = self.hidden_states(inputs, h, keep)
        at = np.flatnonzero(mask.ravel())
        logp, back = self.log_probs(states.reshape(-1, n)[at], targets.ravel()[at], grads)
        into = np.zeros((mask.size, n), np.float32)
        into[at] = back
        into = np.ascontiguousarray(into.reshape(states.shape).transpose(0, 2, 1))
        going = inputs != self.end
        dgates = np.empty((len(inputs), 3 * n, inputs.shape[1]), np.float32)
        du, db, dh = np.zeros_like(w["u"]), np.zeros_like(w["b"]), np.zeros_like(into[0])
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, a, c = keep[t]
            dh += into[t]
            part, rest = dgates[t], 1 - z
            dc = c * c
            np.subtract(1, dc, out=dc)
            dc *= rest
            dc *= dh
            rest *= z
            rest *= before - c
            np.multiply(rest, dh, out=part[:n])
            da = np.multiply(dc, r, out=part[2 * n :])
            dr = np.multiply(da, a, out=part[n : 2 * n])
            dr *= 1 - r
            du += before @ part.T
            db += da.sum(1)
            dh *= z
            dh += w["u"] @ part
            if not going[t].all():
                dh *= going[t]
            # what the input's own part of the candidate gets, which the reset gate does not hold back
            part[2 * n :] = dc
        ids = inputs.ravel().astype(np.int64)
        dx = np.stack([np.bincount(ids, dgates[:, k].ravel(), len(w["x"])) for k in range(3 * n)], 1)
        return -logp.sum() / max(1, len(at)), {"x": dx.astype(np.float32), "u": du, "b": db, **grads}, last

    def train(self, docs: list[np.ndarray], updates: int = 0, planned: int = 0, lanes: int = LANES, steps: int = STEPS, rate: float = RATE) -> float:
        """Passes over docs (ids without the end) until so many updates are made, and one whole pass at least; the last loss.

        The rate falls to a tenth over `planned` updates, counted over all calls.
        """
        if not docs:
            return 0.0
        docs, goes_on, cut = segments(docs)
        size = [len(d) + 1 for d in docs]
        # lanes of one length: none is left alone with one long document
        lanes = max(4, min(lanes, sum(size) // max(size)))
        rnd, begun, loss = np.random.default_rng((SEED, self.done)), self.done, 0.0
        while self.done == begun or self.done - begun < updates:
            order = rnd.permutation(len(docs))
            tokens, owner, size = lanes_of([docs[k] for k in order], lanes, self.end)
            windows = -(-len(tokens) // steps)
            planned = planned or max(1, -(-updates // windows)) * windows
            h = np.zeros((tokens.shape[1], self.hidden), np.float32)
            inputs = np.concatenate([np.full((1, tokens.shape[1]), self.end), tokens[:-1]])
            # a word that a segment takes over was learnt in the one before, and a cut is no end
            learnt = (np.arange(len(tokens))[:, None] < size) & ~((inputs == self.end) & goes_on[order][owner]) & ~((tokens == self.end) & cut[order][owner])
            for t in range(0, len(tokens), steps):
                active = int((size > t).sum())
                part = slice(t, t + steps)
                mask = learnt[part, :active]
                if not mask.any():
                    continue
                loss, grads, h = self.gradients(inputs[part, :active], tokens[part, :active], mask, h[:active])
                # smaller where few lanes are left to speak for the rest
                self.update(grads, mask.sum(), rate * (1 - 0.9 * min(1, self.done / planned)) * active / len(size))
        return loss

    def update(self, grads: dict, count: int, rate: float) -> None:
        """One step by moments of the mean gradient, whose norm is held to 0.5."""
        if not self.done:
            self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.w.items()}
        self.done += 1
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values())) / count
        for k, g in grads.items():
            g = g * np.float32(min(1, 0.5 / (norm + 1e-12)) / count)
            m, s = self.moments[k]
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            self.w[k] -= np.float32(rate) * (m / (1 - 0.9**self.done)) / (np.sqrt(s / (1 - 0.99**self.done)) + 1e-6)

    def score(self, docs: list[np.ndarray], lanes: int = SCORE_LANES, steps: int = STEPS) -> np.ndarray:
        """Natural log probability of each document and its end."""
        out = np.zeros(len(docs))
        if not docs:
            return out
        tokens, owner, size = lanes_of(docs, lanes, self.end)
        h = np.zeros((tokens.shape[1], self.hidden), np.float32)
        last = np.full((1, tokens.shape[1]), self.end)
        t, wide = 0, lanes * steps
        while t < len(tokens):
            active = int((size > t).sum())
            # as few lanes are left, longer windows: as many tokens at once
            steps = max(steps, min(wide // active, LONGEST_WINDOW))
            now = tokens[t : t + steps, :active]
            inputs = np.concatenate([last[:, :active], now[:-1]])
            last = now[-1:]
            states, h = self.hidden_states(inputs, h[:active])
            at = np.flatnonzero((np.arange(t, t + len(now))[:, None] < size[:active]).ravel())
            logp, _ = self.log_probs(states.reshape(-1, self.hidden)[at], now.ravel()[at])
            out += np.bincount(owner[t : t + steps, :active].ravel()[at], logp, len(docs))
            t += steps
        return out

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.w)
        return out.getvalue()


def segments(docs: list[np.ndarray], most: int = SEGMENT) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Documents in parts of `most` tokens, each opened by the last token of the part before it; which parts go on from another, and which are cut off."""
    out, goes_on, cut = [], [], []
    for d in docs:
        for a in range(0, max(1, len(d)), most):
            out.append(d[max(0, a - 1) : a + most])
            goes_on.append(a > 0)
            cut.append(a + most < len(d))
    return out, np.array(goes_on, bool), np.array(cut, bool)


def lanes_of(docs: list[np.ndarray], lanes: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, each with its end, dealt to lanes of about equal length: tokens and owners (steps, lanes), and the lanes' lengths, falling."""
    heap = [(0, k) for k in range(min(lanes, len(docs)))]
    member: list[list[int]] = [[] for _ in heap]
    sizes = [len(d) + 1 for d in docs]
    for i in sorted(range(len(docs)), key=lambda i: -sizes[i]):
        held, k = heapq.heappop(heap)
        member[k].append(i)
        heapq.heappush(heap, (held + sizes[i], k))
    total = np.array([sum(sizes[i] for i in x) for x in member])
    by = np.argsort(-total, kind="stable")
    tokens, owner = np.full((int(total.max()), len(by)), end, np.int32), np.zeros((int(total.max()), len(by)), np.int32)
    for lane, k in enumerate(by.tolist()):
        own = sorted(member[k])
        tokens[: total[k], lane] = np.concatenate([x for i in own for x in (docs[i], [end])])
        owner[: total[k], lane] = np.repeat(own, [sizes[i] for i in own])
    return tokens, owner, total[by]


def _count(batches: Iterator[pa.RecordBatch], most: int = 300_000) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task's tokens; handed on whenever it holds very many."""
    T.forget()
    found: Counter = Counter()

    def out():
        return pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "c": pa.array(list(found.values()), pa.int64())})

    for records in batches:
        for text in records["text"].to_pylist():
            for part in T.pieces((text or "").encode().lower(), 8 << 20):
                found.update(part.split())
                if len(found) > most:
                    yield out()
                    found.clear()
            found[END] += 1
    if found:
        yield out()


def _ids(words: list[bytes], index: dict, other: int) -> np.ndarray:
    return np.fromiter(map(index.get, words, itertools.repeat(other)), np.int32, len(words))


def _train(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Weights after the task's documents, TRAIN_TOKENS of them at a time."""
    T.forget()
    index, counts, _, _ = model.value
    net, total, calls = Gru(counts), 0, 0
    docs = (_ids(words_of(t), index, len(counts) - 2) for records in batches for t in records["text"].to_pylist())
    for some in T.chunks(docs, lambda d: len(d) + 1, TRAIN_TOKENS):
        held = sum(len(d) + 1 for d in some)
        short = not calls and held < TRAIN_TOKENS
        net.train(some, LEAST_UPDATES if short else 0, 0 if short else TRAINER_TOKENS // (LANES * STEPS))
        total, calls = total + held, calls + 1
    if calls:
        yield pa.RecordBatch.from_pydict({"n": [total], "w": [net.dump()]})


def _copies(training: DataFrame, trainers: int, model) -> DataFrame:
    """Each trainer's tokens and weights; together they read every row of training."""
    return training.select("text", "d", "h").repartition(trainers, "d", "h").sortWithinPartitions("d", "h").select("text").mapInArrow(lambda it: _train(it, model), "n long, w binary")


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the mean of the weights, each counted by its tokens."""
    total, held = 0, None
    for records in batches:
        for n, w in zip(records["n"].to_pylist(), records["w"].to_pylist(), strict=True):
            own = {k: v.astype(np.float64) * n for k, v in np.load(io.BytesIO(w)).items()}
            held = own if held is None else {k: held[k] + own[k] for k in own}
            total += n
    if total:
        out = io.BytesIO()
        np.savez(out, **{k: (v / total).astype(np.float32) for k, v in held.items()})
        yield pa.RecordBatch.from_pydict({"n": [total], "w": [out.getvalue()]})


def _score(batches: Iterator[pa.RecordBatch], model, weights, total: float, other_total: float) -> Iterator[pa.RecordBatch]:
    """For each document a row with what the cache's words give, under a word that no text holds, and a row for each of its other words."""
    T.forget()
    index, counts, known, known_counts = model.value
    net = Gru(counts)
    net.w = weights.value
    other, unknown = len(counts) - 2, len(known)
    base = np.log10((known_counts + 0.1) / total)
    share = np.where(np.arange(unknown) < other, 0, np.log10((known_counts + 0.1) / other_total))
    end_at = known[END]
    share[end_at] = 0
    to_vocabulary = np.array([index.get(w, net.end if w == END else other) for w in known] + [other], np.int32)
    for records in batches:
        for a in range(0, len(records), 4096):
            rows = records.slice(a, 4096)
            docs, sums, rare, times, owner = [], [], [], [], []
            for i, text in enumerate(rows["text"].to_pylist()):
                words = words_of(text)
                ids = _ids(words, known, unknown)
                docs.append(to_vocabulary[ids])
                seen = ids[ids < unknown]
                sums.append((len(ids) + 1, len(seen) + 1, base[seen].sum() + base[end_at], share[seen].sum()))
                found = Counter(map(words.__getitem__, np.flatnonzero(ids == unknown).tolist()))
                rare += found
                times += found.values()
                owner.append(len(found))
            logp = net.score(docs) / np.log(10)
            n, k, b, s = (np.array(x) for x in zip(*sums, strict=True))
            values = [pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(b), pa.array(logp + s)]
            own = [END + d.to_bytes(8, "little", signed=True) for d in rows["h"].to_pylist()]
            schema = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("word", pa.binary()), ("n", pa.int64()), ("doc", pa.struct([("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())]))])
            yield pa.RecordBatch.from_arrays([rows["d"], rows["h"], pa.array(own, pa.binary()), pa.array([0] * len(rows), pa.int64()), pa.StructArray.from_arrays(values, fields=list(schema.field("doc").type))], schema=schema)
            if rare:
                at = pa.array(np.repeat(np.arange(len(rows)), owner))
                yield pa.RecordBatch.from_arrays([rows["d"].take(at), rows["h"].take(at), pa.array(rare, pa.binary()), pa.array(times, pa.int64()), pa.nulls(len(rare), schema.field("doc").type)], schema=schema)


def score_documents(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_tokens, n_known, train_tokens, base_score, score); `learn` holds for the training rows."""
    spark = docs.sparkSession
    held = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    training = held.where("learn")
    counts = checkpoint(training.select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = int(totals[0]), int(totals[1])
    often = most_frequent(counts.where(F.col("word") != F.lit(END)), "c", CACHE).select("word", "c").toArrow()
    top = sorted(zip(often["word"].to_pylist(), often["c"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    end_row = counts.where(F.col("word") == F.lit(END)).first()
    ends = end_row["c"] if end_row else 0
    vocabulary = top[:VOCABULARY]
    index = {w: k for k, (w, _) in enumerate(vocabulary)}
    inside = sum(c for _, c in vocabulary)
    others = n - inside - ends
    sizes = np.array([*(c for _, c in vocabulary), others, ends], np.float64)
    # the end comes last, after the other words of the cache
    known = {w: k for k, (w, _) in enumerate([*top, (END, ends)])}
    known_counts = np.array([*(c for _, c in top), ends], np.float64)
    total = n + 0.1 * (v + 1)
    other_total = others + 0.1 * (max(0, v - len(vocabulary) - (ends > 0)) + 1)
    model = spark.sparkContext.broadcast((index, sizes, known, known_counts))

    trainers = max(1, n // TRAINER_TOKENS)
    copies = _copies(training, trainers, model)
    # averaged in two levels: the driver gets a root of the number of copies
    groups = math.isqrt(trainers - 1) + 1
    trained = checkpoint(copies).repartition(groups).mapInArrow(_average, "n long, w binary").collect()
    net = Gru(sizes)
    if trained:
        table = pa.RecordBatch.from_pydict({"n": [r["n"] for r in trained], "w": [bytes(r["w"]) for r in trained]})
        mean, = _average(iter([table]))
        loaded = np.load(io.BytesIO(mean["w"][0].as_py()))
        net.w = {k: loaded[k] for k in Gru.NAMES}
    weights = spark.sparkContext.broadcast(net.w)

    schema = "d long, h long, word binary, n long, doc struct<n_tokens: long, known: long, base: double, score: double>"
    found = held.select("d", "h", "text").mapInArrow(lambda it: _score(it, model, weights, total, other_total), schema)
    c = F.coalesce(F.col("c"), F.lit(0))
    log_base, log_share = F.log10((c + 0.1) / F.lit(total)), F.log10((c + 0.1) / F.lit(other_total))
    sums = found.join(counts, "word", "left").groupBy("d", "h").agg(
        F.count("doc").alias("copies"),
        *[F.max(f"doc.{x}").alias(x) for x in ("n_tokens", "known", "base", "score")],
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"),
        F.sum(F.col("n") * log_base).alias("base_more"),
        F.sum(F.col("n") * log_share).alias("score_more"),
    )
    # copies of a document have given their words together
    each = sums.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    part = lambda x: F.col(x) / F.col("copies")
    return each.select(F.col("d").alias(id_col), "n_tokens", (F.col("known") + part("more")).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + part("base_more")).alias("base_score"), (F.col("score") + part("score_more")).alias("score"))
