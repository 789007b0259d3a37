"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is read as overlapping windows of WINDOW words, STRIDE apart; every window is scored and the text has the score of its
most toxic window. A word comes in as a learned vector of the word (lower case, without outer punctuation; words that
the training sample has too rarely share one) next to the mean of learned vectors of its runs of three and four bytes. Two gated
recurrent networks run over the window in both directions, attention pools their states, and a logistic unit gives the
score. The network is trained in numpy on a bounded sample of labelled rows outside the held-out fold, with all windows
of each: at most SAMPLE documents that are SAMPLE_BYTES together, none of more than LARGEST bytes. Only documents have
labels, so each round learns from the window that the network finds most toxic in a document.

Labels, language, source and id are no inputs. Training is repeatable: sample, order and first weights are fixed.

Defined cases: null texts are empty; very long texts are scored whole, in pieces with the same windows; a text without words is one window without words; repeated rows keep a row each;
null ids are not held out and not learnt from; without labels of both kinds every score is the share of 1 among the
labels (0 without any); extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, text_of, training_rows

WINDOW, STRIDE = 48, 36
SAMPLE = 3000
SAMPLE_BYTES, LARGEST = 12 << 20, 1 << 20
VOCABULARY = 30_000
GRAMS = 8192
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 12, 8, 8, 8
#: Share of words that a training step shows by their characters alone, and of windows of one repeated word.
DROPPED, REPEATED = 0.25, 0.05
THRESHOLD = 0.5
#: Distinct words whose inputs a worker keeps; words and windows scored at once; words whose characters are looked up at once.
KEPT_WORDS, WORDS_AT_ONCE, WINDOWS_AT_ONCE, WORDS_SPELLED = 200_000, 100_000, 2048, 10_000

Array = np.ndarray


def plain(word: str) -> str:
    w = word.lower()
    if w.isalpha():
        return w
    i, j = 0, len(w)
    while i < j and not w[i].isalnum():
        i += 1
    while j > i and not w[j - 1].isalnum():
        j -= 1
    return w[i:j]


def grams_of(words: list[str]) -> tuple[Array, Array]:
    """(numbers of the grams of all words, word after word; how many each word has)."""
    spelled = [f"<{w}>".encode("utf-8", "replace").ljust(4, b"\0") for w in words]
    size = np.array([len(b) for b in spelled], np.int64)
    data = np.frombuffer(b"".join(spelled), np.uint8).astype(np.uint64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(data))
    owner = np.repeat(np.arange(len(words)), size)
    code = data[:-2] | data[1:-1] << np.uint64(8) | data[2:] << np.uint64(16)
    longer = code[:-1] | data[3:] << np.uint64(24)
    three, four = left[:-2] >= 3, left[:-3] >= 4
    grams = np.concatenate([code[three], longer[four]])
    order = np.argsort(np.concatenate([owner[:-2][three], owner[:-3][four]]), kind="stable")
    return (grams[order] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % GRAMS, 2 * size - 5


def sigmoid(x: Array) -> Array:
    return 1 / (1 + np.exp(-x))


def starts(n: int) -> list[int]:
    """Window starts over n words: every word is in a window, and neighbours overlap."""
    return [0, *range(STRIDE, n - WINDOW + STRIDE, STRIDE)] if n > WINDOW else [0]


class Network:
    """Weights, forward and backward pass. Words are rows of a table of (word vector number, mean of its grams)."""

    def __init__(self, words: list[str], odds: Array, gram_odds: Array, seed: int = 5):
        g = np.random.default_rng(seed)
        r = lambda a, b, s=1.0: (g.standard_normal((a, b)) * s / np.sqrt(a)).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.number = {w: i + 1 for i, w in enumerate(words)}
        emb = (g.standard_normal((len(words) + 1, WORD_DIM)) * 0.1).astype(np.float32)
        emb[1:, 0] = odds  # starts from how much likelier the word is in documents of label 1
        emb[0] = 0
        chars = (g.standard_normal((GRAMS, CHAR_DIM)) * 0.1).astype(np.float32)
        chars[:, 0] = gram_odds
        self.p = {"E": emb, "C": chars}
        for k in "fb":
            self.p |= {f"W{k}": r(d, 3 * HIDDEN), f"U{k}": r(HIDDEN, 3 * HIDDEN), f"B{k}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": r(2 * HIDDEN, ATTENTION), "a": r(ATTENTION, 1)[:, 0], "o": r(2 * HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32)}

    # inputs

    def inputs(self, words: list[str]) -> Array:
        """The input vector of each of some words."""
        p = [plain(w) for w in words]
        grams, size = grams_of(p)
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        chars = np.add.reduceat(self.p["C"][grams], at, axis=0) / size[:, None]
        return np.concatenate([self.p["E"][[self.number.get(w, 0) for w in p]], chars], axis=1).astype(np.float32)

    # forward

    def scan(self, k: str, x: Array, mask: Array, back: bool, keep: list | None = None) -> Array:
        """States (T, n, HIDDEN) for projected inputs x (T, n, 3 HIDDEN); a masked step leaves the state as it is."""
        T, n, _ = x.shape
        U, H = self.p[f"U{k}"], HIDDEN
        h = np.zeros((n, H), np.float32)
        out = np.empty((T, n, H), np.float32)
        for t in range(T - 1, -1, -1) if back else range(T):
            u = h @ U
            zr = sigmoid(x[t, :, : 2 * H] + u[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(x[t, :, 2 * H :] + r * u[:, 2 * H :])
            z = z + (1 - z) * (1 - mask[t])  # a masked step keeps all
            if keep is not None:
                keep.append((t, h, z, r, c, u[:, 2 * H :]))
            h = c + z * (h - c)
            out[t] = h
        return out

    def pooled(self, hf: Array, hb: Array, mask: Array) -> tuple[Array, ...]:
        h = np.concatenate([hf, hb], axis=2)
        s = np.tanh(h @ self.p["A"])
        e = s @ self.p["a"] + (mask[..., 0] - 1) * 30
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        v = (h * e[..., None]).sum(0)
        return h, s, e, v, v @ self.p["o"] + self.p["c"]

    def logits(self, ids: Array, fx: Array, bx: Array) -> Array:
        """Scores before the logistic of windows ids (n, WINDOW); -1 stands for no word. fx, bx: projected inputs of the words."""
        ids = ids.T
        mask = (ids >= 0).astype(np.float32)[..., None]
        return self.pooled(self.scan("f", fx[ids], mask, False), self.scan("b", bx[ids], mask, True), mask)[4]

    def projected(self, x: Array) -> tuple[Array, Array]:
        return x @ self.p["Wf"] + self.p["Bf"], x @ self.p["Wb"] + self.p["Bb"]

    # backward

    def unscan(self, k: str, kept: list, mask: Array, dh: Array, g: dict[str, Array]) -> Array:
        """Gradient of projected inputs from that of the states."""
        H, U = HIDDEN, self.p[f"U{k}"]
        dx = np.empty((*dh.shape[:2], 3 * H), np.float32)
        carry = np.zeros(dh.shape[1:], np.float32)
        gU = np.zeros_like(U)
        for t, h, z, r, c, uc in reversed(kept):
            d = dh[t] + carry
            dz = d * (h - c) * mask[t]
            raw = np.where(mask[t] > 0, z, 0.5)
            dc = d * (1 - z) * (1 - c * c)
            du = np.concatenate([dz * raw * (1 - raw), dc * uc * r * (1 - r), dc * r], axis=1)
            dx[t, :, : 2 * H], dx[t, :, 2 * H :] = du[:, : 2 * H], dc
            gU += h.T @ du
            carry = d * z + du @ U.T
        g[f"U{k}"] = gU
        return dx

    def gradients(self, ids: Array, x: Array, y: Array, weight: Array) -> tuple[dict[str, Array], Array, Array]:
        """(gradients of the weights, gradient of the words' inputs x, scores) of the weighted log loss."""
        ids = ids.T
        mask = (ids >= 0).astype(np.float32)[..., None]
        fx, bx = self.projected(x)
        kf: list = []
        kb: list = []
        hf, hb = self.scan("f", fx[ids], mask, False, kf), self.scan("b", bx[ids], mask, True, kb)
        h, s, e, v, out = self.pooled(hf, hb, mask)
        score = sigmoid(out)
        go = ((score - y) * weight / weight.sum()).astype(np.float32)
        g = {"o": v.T @ go, "c": np.array([go.sum()], np.float32)}
        dv = go[:, None] * self.p["o"]
        de = (h * dv).sum(2)
        de = e * (de - (e * de).sum(0))
        ds = de[..., None] * self.p["a"] * (1 - s * s)
        g["a"] = (s * de[..., None]).sum((0, 1))
        g["A"] = np.tensordot(h, ds, ((0, 1), (0, 1)))
        dh = e[..., None] * dv + ds @ self.p["A"].T
        dx = np.zeros_like(x)
        flat = ids.ravel()
        some = flat >= 0
        for k, kept, part in (("f", kf, dh[..., :HIDDEN]), ("b", kb, dh[..., HIDDEN:])):
            d = self.unscan(k, kept, mask, part, g).reshape(-1, 3 * HIDDEN)[some]
            rows = np.zeros((len(x), 3 * HIDDEN), np.float32)
            np.add.at(rows, flat[some], d)
            g[f"W{k}"], g[f"B{k}"] = x.T @ rows, rows.sum(0)
            dx += rows @ self.p[f"W{k}"].T
        return g, dx, score


def log_odds(with1: Array, with0: Array, n1: int, n0: int) -> Array:
    """How much likelier something is in documents of label 1, where enough documents have it to tell."""
    odds = np.clip(np.log((with1 + 0.5) / (n1 + 1)) - np.log((with0 + 0.5) / (n0 + 1)), -4, 4)
    return np.where(np.abs(odds) * np.sqrt(np.minimum(with1 + with0, 50)) > 3, odds, 0).astype(np.float32) / 2


def fit(texts: Iterable[list[str]], y: Array, rounds: int = 9, rate: float = 0.01, batch: int = 128) -> Network:
    """texts: the words of each document, read once; they are held as numbers of distinct words."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    gram_seen = np.zeros((2, GRAMS))
    index: dict[str, int] = {}
    windows: list[Array] = []
    for words, label in zip(texts, y):
        words = [plain(w) for w in words]
        distinct = set(words)
        seen[int(label)].update(distinct)
        if distinct:
            gram_seen[int(label), np.unique(grams_of(list(distinct))[0])] += 1
        numbers = np.array([index.setdefault(w, len(index)) for w in words], np.int32)
        place = np.array(starts(len(words)))[:, None] + np.arange(WINDOW)
        windows.append(np.where(place < len(numbers), numbers[np.minimum(place, max(0, len(numbers) - 1))], -1).astype(np.int32) if len(numbers) else np.full((1, WINDOW), -1, np.int32))
    total = seen[0] + seen[1]
    words = sorted((w for w, n in total.items() if n >= 4 and w), key=lambda w: (-total[w], w))[:VOCABULARY]
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    net = Network(words, log_odds(np.array([seen[1][w] for w in words]), np.array([seen[0][w] for w in words]), n1, n0), log_odds(gram_seen[1], gram_seen[0], n1, n0))
    vocabulary = list(index) or [""]
    number = np.array([net.number.get(w, 0) for w in vocabulary])
    parts = [grams_of(vocabulary[a : a + WORDS_SPELLED]) for a in range(0, len(vocabulary), WORDS_SPELLED)]
    gram, size = np.concatenate([p[0].astype(np.int32) for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    gram_of = np.repeat(np.arange(len(vocabulary), dtype=np.int32), size)
    gram_at = np.concatenate(([0], np.cumsum(size)[:-1]))
    ids = np.concatenate(windows)
    owner = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
    del windows
    at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))

    def inputs() -> Array:
        out = np.empty((len(vocabulary), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = net.p["E"][number]
        for a in range(0, len(vocabulary), WORDS_SPELLED):
            at, n = gram_at[a : a + WORDS_SPELLED], size[a : a + WORDS_SPELLED]
            out[a : a + WORDS_SPELLED, WORD_DIM:] = np.add.reduceat(net.p["C"][gram[at[0] : at[-1] + n[-1]]], at - at[0], axis=0) / n[:, None]
        return out

    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    g = np.random.default_rng(3)
    n = 0
    lead = inputs()[:, [0, WORD_DIM]].max(1)
    signal = np.concatenate([np.where(part >= 0, lead[np.maximum(part, 0)], -9).max(1) for part in (ids[i : i + WINDOWS_AT_ONCE] for i in range(0, len(ids), WINDOWS_AT_ONCE))])
    for done in range(rounds):
        if done and done % 2 == 0 or done == 1:
            x = inputs()
            fx, bx = net.projected(x)
            signal = np.concatenate([net.logits(ids[i : i + WINDOWS_AT_ONCE], fx, bx) for i in range(0, len(ids), WINDOWS_AT_ONCE)])
        best = np.array([a + int(np.argmax(signal[a:b])) for a, b in zip(at, [*at[1:], len(ids)])])
        other = np.flatnonzero((y[owner] == 0) & (g.random(len(ids)) < 0.05))
        repeated = g.choice(other, int(REPEATED * len(best))) if len(other) else other
        ones = np.repeat(np.maximum(ids[repeated, 0], 0)[:, None], WINDOW, axis=1)
        shown = np.concatenate([ids[best], ids[other], ones])
        target = np.concatenate([y, np.zeros(len(other) + len(ones))]).astype(np.float32)
        weight = np.concatenate([np.ones(len(best)), np.full(len(other) + len(ones), 0.3)]).astype(np.float32)
        order = g.permutation(len(shown))
        lr = rate * (1 - done / rounds) + 1e-4
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            used, local = np.unique(shown[some], return_inverse=True)
            local = local.reshape(len(some), WINDOW) - (used[0] < 0)
            used = used[used >= 0]
            if not len(used):
                continue
            picked = np.flatnonzero(np.isin(gram_of, used)) if len(used) * 4 > len(vocabulary) else np.concatenate([np.arange(gram_at[u], gram_at[u] + size[u]) for u in used])
            place = np.repeat(np.arange(len(used)), size[used])
            chars = np.zeros((len(used), CHAR_DIM), np.float32)
            np.add.at(chars, place, net.p["C"][gram[picked]])
            chars /= size[used][:, None]
            entry = np.where(g.random(len(used)) < DROPPED, 0, number[used])
            x = np.concatenate([net.p["E"][entry], chars], axis=1).astype(np.float32)
            grad, dx, _ = net.gradients(local, x, target[some], weight[some])
            gE, gC = np.zeros_like(net.p["E"]), np.zeros_like(net.p["C"])
            np.add.at(gE, entry, dx[:, :WORD_DIM])
            gE[0] = 0
            np.add.at(gC, gram[picked], (dx[:, WORD_DIM:] / size[used][:, None])[place])
            grad |= {"E": gE, "C": gC}
            n += 1
            for k in net.p:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                net.p[k] = (net.p[k] - lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores texts; keeps the projected inputs of words that come again, in bounded memory."""

    def __init__(self, net: Network):
        self.net = net
        self.rows: dict[str, int] = {}
        self.fx = np.zeros((0, 3 * HIDDEN), np.float32)
        self.bx = np.zeros((0, 3 * HIDDEN), np.float32)
        self.used = 0

    def learn(self, words: list[str]) -> None:
        fx, bx = self.net.projected(self.net.inputs(words))
        need = self.used + len(words)
        if need > len(self.fx):
            more = max(need, min(2 * need, KEPT_WORDS + len(words)))
            for k in ("fx", "bx"):
                grown = np.zeros((more, 3 * HIDDEN), np.float32)
                grown[: self.used] = getattr(self, k)[: self.used]
                setattr(self, k, grown)
        self.fx[self.used : need], self.bx[self.used : need] = fx, bx
        self.rows.update(zip(words, range(self.used, need)))
        self.used = need

    def scores(self, texts: list[str]) -> Array:
        out = np.zeros(len(texts))
        parts: list[tuple[int, list[str]]] = []
        total = 0
        for k, text in enumerate(texts):
            words = text.split()
            # long texts in pieces; the next piece starts where this one's windows end, if a window starts there
            for a in range(0, max(len(words) - WINDOW + STRIDE, 1), 1000 * STRIDE):
                parts.append((k, words[a : a + 1000 * STRIDE + WINDOW - STRIDE]))
                total += len(parts[-1][1])
                if total >= WORDS_AT_ONCE:
                    self.score_parts(parts, out)
                    parts, total = [], 0
        self.score_parts(parts, out)
        return out

    def score_parts(self, parts: list[tuple[int, list[str]]], out: Array) -> None:
        """Raises the scores of texts to those of their windows."""
        if self.used > KEPT_WORDS:
            self.rows, self.used = {}, 0
        fresh = list({w for _, words in parts for w in words if w not in self.rows}) or ([""] if self.used == 0 else [])
        for a in range(0, len(fresh), WORDS_SPELLED):
            self.learn(fresh[a : a + WORDS_SPELLED])
        rows = self.rows
        flat = np.array([rows[w] for _, words in parts for w in words] or [0], np.int64)
        begin, end, owner, at = [], [], [], 0
        for k, words in parts:
            s = starts(len(words))
            begin += [at + i for i in s]
            owner += [k] * len(s)
            at += len(words)
            end += [at] * len(s)
        for i in range(0, len(begin), WINDOWS_AT_ONCE):
            place = np.array(begin[i : i + WINDOWS_AT_ONCE])[:, None] + np.arange(WINDOW)
            ids = np.where(place < np.array(end[i : i + WINDOWS_AT_ONCE])[:, None], flat[np.minimum(place, len(flat) - 1)], -1)
            np.maximum.at(out, owner[i : i + WINDOWS_AT_ONCE], sigmoid(np.clip(self.net.logits(ids, self.fx, self.bx), -30, 30)))


class Constant:
    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[str]) -> Array:
        return np.full(len(texts), self.share)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Network | float:
    """Fits the network on at most `sample` labelled documents; executors cut the windows."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                out.append(" ".join(t.split()))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(1)], names=["words", "y"])

    rows = training_rows(docs, labels, label, sample, SAMPLE_BYTES, LARGEST, id_col, text_col).mapInArrow(run, "words string, y int").orderBy(F.xxhash64("words"), "y").toArrow()
    y = rows.column("y").to_numpy().astype(np.float32)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    return fit((x.as_py().split() for c in rows.column("words").chunks for x in c), y)


def scorer(model: Network | float) -> Scorer | Constant:
    """A scorer of a task: what it keeps of words goes when the task ends."""
    return Constant(model) if isinstance(model, float) else Scorer(model)


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a network of bounded size
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared.value)
        for b in batches:
            if b.num_rows:
                s = own.scores(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.astype(np.float64))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole and with their columns, whose text scores below the threshold. One pass, no join."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(shared.value)
        for b in batches:
            if b.num_rows:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array(own.scores([t or "" for t in texts]) < threshold))

    return docs.mapInArrow(run, docs.schema)
