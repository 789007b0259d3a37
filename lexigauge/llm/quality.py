"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Each passage is encoded from its byte frequencies and word statistics;
gated attention weighs the passages; the weighted representation gives the score. Only documents have labels: the
attention learns from them which passages tell. The network is trained in numpy on a bounded sample of labelled rows
outside the held-out fold, and every passage of a training document is learned from: at most SAMPLE documents that are
SAMPLE_BYTES together, none of more than LARGEST bytes. It scores every passage of every text.

Labels, language, source and id are no inputs. Training is repeatable: sample, order and first weights are fixed.

Defined cases: null texts are empty; very long texts are scored whole, in blocks; an empty text is one passage without bytes and gets that passage's score; repeated
rows keep a row each; null ids are not held out and not learnt from; without labels of both kinds every score is the
share of 1 among the labels (0.5 without any); extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, text_of, training_rows

PASSAGE = 1000
SAMPLE = 4000
SAMPLE_BYTES, LARGEST = 48 << 20, 2 << 20
THRESHOLD = 0.3
HIDDEN, ATTENTION = 24, 12
STATS = 6
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def features(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte frequencies and word statistics of passages that stand one after another in data."""
    n = len(sizes)
    out = np.zeros((n, 256 + STATS), np.float32)
    if not len(data):
        return out
    pid = np.repeat(np.arange(n), sizes)
    length = np.maximum(sizes, 1)[:, None]
    out[:, :256] = np.sqrt(np.bincount(pid * 256 + data, minlength=n * 256).reshape(n, 256) / length)
    out[:, 256] = np.log1p(sizes) / 7
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1] | (pid[1:] != pid[:-1])
    starts = np.flatnonzero(begins)
    if len(starts):
        pos = np.arange(len(data)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(data)]))))
        value = (data.astype(np.uint64) + np.uint64(1)) * _POWER[pos & 255]
        value[space] = 0
        word = np.add.reduceat(value, starts)
        word ^= word >> np.uint64(31)
        owner = pid[starts]
        count = np.bincount(owner, minlength=n)
        most = np.maximum(count, 1)
        out[:, 257] = count / length[:, 0] * 5
        out[:, 258] = (sizes - np.bincount(pid[space], minlength=n)) / most / 10
        same = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        out[:, 259] = np.bincount(owner[1:][same], minlength=n) / most
        key = np.sort((word & np.uint64((1 << 40) - 1)) | (owner.astype(np.uint64) << np.uint64(40)))
        first = np.concatenate(([True], key[1:] != key[:-1]))
        out[:, 260] = np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=n) / most
    out[:, 261] = np.bincount(pid[data == 10], minlength=n) / length[:, 0] * 20
    return out


def bags(texts: list[bytes], passage: int = PASSAGE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (data, sizes of passages, text number of each passage) of bounded size; a long text goes over several."""
    parts, sizes, owners, total = [], [], [], 0
    for k, t in enumerate(texts):
        for i in range(0, max(len(t), 1), passage):
            p = t[i : i + passage]
            parts.append(p)
            sizes.append(len(p))
            owners.append(k)
            total += len(p)
            if total >= BLOCK:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(sizes), np.array(owners)
                parts, sizes, owners, total = [], [], [], 0
    if sizes:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(sizes), np.array(owners)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Passage encoder, gated attention over a bag, and a logistic score."""

    def __init__(self, width: int, seed: int = 7):
        g = np.random.default_rng(seed)
        r = lambda a, b: (g.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.p = {"W": r(width, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": r(HIDDEN, ATTENTION), "U": r(HIDDEN, ATTENTION), "w": r(ATTENTION, 1)[:, 0], "c": r(HIDDEN, 1)[:, 0], "d": np.zeros(1, np.float32)}
        self.mean, self.std = np.zeros(width, np.float32), np.ones(width, np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(representation, attention before the softmax) of passages."""
        h = np.tanh(((x - self.mean) / self.std) @ self.p["W"] + self.p["b"])
        return h, (np.tanh(h @ self.p["V"]) * sigmoid(h @ self.p["U"])) @ self.p["w"]

    def pool(self, h: np.ndarray, a: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(attention weights, bag representation, score) for bags that start at `at`."""
        size = np.diff(np.append(at, len(a)))
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, at), size))
        e /= np.repeat(np.add.reduceat(e, at), size)
        z = np.add.reduceat(h * e[:, None], at, axis=0)
        return e, z, sigmoid(z @ self.p["c"] + self.p["d"])

    def step(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over bags; x is standardised."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e, z, score = self.pool(h, (t * s) @ p["w"], at)
        size = np.diff(np.append(at, len(x)))
        go = (score - y) / len(y)
        gz = np.repeat(go[:, None] * p["c"], size, axis=0)
        ge = (gz * h).sum(1)
        ga = e * (ge - np.repeat(np.add.reduceat(e * ge, at), size))
        gt, gs = ga[:, None] * p["w"] * s * (1 - t * t), ga[:, None] * p["w"] * t * s * (1 - s)
        gh = (gz * e[:, None] + gt @ p["V"].T + gs @ p["U"].T) * (1 - h * h)
        g = {"W": x.T @ gh, "b": gh.sum(0), "V": h.T @ gt, "U": h.T @ gs, "w": ((t * s) * ga[:, None]).sum(0), "c": z.T @ go, "d": np.array([go.sum()])}
        return {k: v + decay * p[k] for k, v in g.items()}

    def fit(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, epochs: int = 30, rate: float = 0.01, batch: int = 64, decay: float = 1e-4) -> None:
        """x may be half floats: it is standardised batch by batch."""
        self.mean, self.std = x.mean(0, dtype=np.float64).astype(np.float32), x.std(0, dtype=np.float64).astype(np.float32) + np.float32(0.02)
        ends = np.append(at[1:], len(x))
        g = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        n = 0
        for epoch in range(epochs):
            order = g.permutation(len(y))
            lr = rate * (1 - epoch / epochs)
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                rows = np.concatenate([np.arange(at[k], ends[k]) for k in some])
                grad = self.step((x[rows] - self.mean) / self.std, np.concatenate(([0], np.cumsum(ends[some] - at[some])[:-1])), y[some], decay)
                n += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * grad[k]
                    v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                    self.p[k] = (self.p[k] - lr * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        h, a, owner = [], [], []
        for data, sizes, who in bags(texts):
            hh, aa = self.encode(features(data, sizes))
            h.append(hh)
            a.append(aa)
            owner.append(who)
        owner = np.concatenate(owner)
        at = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        return self.pool(np.concatenate(h), np.concatenate(a), at)[2]


class Constant:
    """Where there is nothing to learn from."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Attention | Constant:
    """Fits the classifier on at most `sample` labelled documents; executors make the features."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                out.append(b"".join(features(data, sizes).astype(np.float16).tobytes() for data, sizes, _ in bags([t.encode("utf-8", "replace")])))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), b.column(1)], names=["x", "y"])

    rows = training_rows(docs, labels, label, sample, SAMPLE_BYTES, LARGEST, id_col, text_col).mapInArrow(run, "x binary, y int").orderBy(F.xxhash64("x"), "y").toArrow()
    y = rows.column("y").to_numpy().astype(np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Constant(float(y.mean()) if len(y) else 0.5)
    parts = [np.frombuffer(x.as_buffer(), np.float16).reshape(-1, 256 + STATS) for c in rows.column("x").chunks for x in c]
    model = Attention(256 + STATS)
    model.fit(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1])), y)
    return model


def score(docs: DataFrame, model: Attention | Constant, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a network of fixed size
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = shared.value.scores([t.encode("utf-8", "replace") for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.astype(np.float64))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Attention | Constant, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole and with their columns, whose text scores the threshold or more. One pass, no join."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                s = shared.value.scores([(t or "").encode("utf-8", "replace") for t in texts])
                yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(run, docs.schema)
