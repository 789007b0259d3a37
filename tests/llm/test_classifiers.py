"""Quality and toxicity: gradients, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest

from lexigauge.llm import common, quality, toxicity

WORDS = "house tree river stone cloud market garden window bridge letter music winter summer paper silver orange table morning evening forest".split()


def corpus(n, seed=1):
    """(doc_id, text, quality, toxic): junk has marks on its words; toxic texts have one of a few words somewhere."""
    g = random.Random(seed)
    out = []
    for i in range(n):
        words = [g.choice(WORDS) for _ in range(g.randrange(5, 400))]
        junk, toxic = g.random() < 0.3, g.random() < 0.3
        if toxic:
            words.insert(g.randrange(len(words)), g.choice(["Vilaku.", "vilaker", "vilakan!"]))
        if junk:
            words = [w + g.choice(["***", "&&&"]) for w in words]
        out.append((i, " ".join(words), int(not junk), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([(i, t, "src", "score") for i, t, _, _ in rows] + [(10_000, None, None, None), (10_001, "", None, None), (None, "house tree", None, None)], "doc_id long, text string, source string, score string")
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in rows] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def numeric(f, x, at, e=1e-3):
    old = x[at]
    x[at] = old + e
    up = f()
    x[at] = old - e
    down = f()
    x[at] = old
    return (up - down) / (2 * e)


def test_attention_gradients():
    g = np.random.default_rng(0)
    m = quality.Attention(7)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, at, y = g.standard_normal((9, 7)), np.array([0, 2, 5]), np.array([1.0, 0, 1])
    grad = m.step(x, at, y, 0)

    def loss():
        h = np.tanh(x @ m.p["W"] + m.p["b"])
        s = m.pool(h, (np.tanh(h @ m.p["V"]) * quality.sigmoid(h @ m.p["U"])) @ m.p["w"], at)[2]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for k, v in m.p.items():
        i = tuple(g.integers(0, n) for n in v.shape)
        assert grad[k][i] == pytest.approx(numeric(loss, v, i), rel=1e-3, abs=1e-6)


def test_recurrent_gradients():
    g = np.random.default_rng(0)
    net = toxicity.Network(["a", "b"], np.zeros(2), np.zeros(toxicity.GRAMS))
    x = g.standard_normal((5, toxicity.WORD_DIM + toxicity.CHAR_DIM)).astype(np.float32)
    ids = np.array([[0, 1, 2, 3, -1], [4, 1, 1, -1, -1]])
    y, w = np.array([1.0, 0.0], np.float32), np.array([1.0, 0.5], np.float32)
    grad, dx, _ = net.gradients(ids, x, y, w)

    def loss():
        s = toxicity.sigmoid(net.logits(ids, *net.projected(x)).astype(float))
        return -np.sum(w * (y * np.log(s) + (1 - y) * np.log(1 - s))) / w.sum()

    for k in grad:
        v = net.p[k]
        i = tuple(g.integers(0, n) for n in v.shape)
        assert grad[k][i] == pytest.approx(numeric(loss, v, i, 1e-2), rel=0.05, abs=2e-4)
    assert dx[1, 3] == pytest.approx(numeric(loss, x, (1, 3), 1e-2), rel=0.05, abs=2e-4)


def check(scored, truth):
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and len(rows) == len(truth) + 3
    held = [i for i in truth if rows[i]["held_out"]]
    return np.mean([rows[i]["predicted"] == truth[i] for i in held]), rows


def test_quality(tables):
    rows, docs, labels = tables
    model = quality.train(docs, labels)
    right, found = check(quality.score(docs, model), {i: q for i, _, q, _ in rows})
    assert right > 0.97 and found[None]["held_out"] is False
    assert found[10_000]["score"] == found[10_001]["score"]
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in found.values())
    assert quality.score(docs.limit(0), model).count() == 0 and quality.keep(docs.limit(0), model).count() == 0
    nothing = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}


def test_toxicity(tables):
    rows, docs, labels = tables
    model = toxicity.train(docs, labels)
    right, found = check(toxicity.score(docs, model), {i: t for i, _, _, t in rows})
    assert right > 0.97
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in found.values())
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_windows_and_grams():
    for n in (0, 1, 47, 48, 49, 84, 85, 120, 500):
        at = toxicity.starts(n)
        seen = {i for s in at for i in range(s, min(n, s + toxicity.WINDOW))}
        assert seen == set(range(n)) and all(b - a < toxicity.WINDOW for a, b in zip(at, at[1:]))
    flat, size = toxicity.grams_of(["a", "", "word"])
    assert size.tolist() == [3, 3, 7] and len(flat) == size.sum()
    assert (toxicity.grams_of(["word"])[0] == flat[-7:]).all()


@pytest.mark.parametrize("n", [1000 * toxicity.STRIDE + k for k in (-1, 0, 1, 5, 12, 13, 48)] + [2200 * toxicity.STRIDE + 17])
def test_long_text_in_pieces(n):
    """A very long text, scored in pieces, has the score of its most toxic window over the whole: no window more, none less."""
    g = random.Random(2)
    words = [f"w{g.randrange(40)}" for _ in range(n - 3)] + ["w7"] * 3
    net = toxicity.Network([f"w{k}" for k in range(40)], np.array([g.gauss(0, 2) for _ in range(40)]), np.zeros(toxicity.GRAMS))
    index = {f"w{k}": k for k in range(40)}
    fx, bx = net.projected(net.inputs(list(index)))
    wins = [words[s : s + toxicity.WINDOW] for s in toxicity.starts(len(words))]
    ids = np.array([[index[w] for w in x] + [-1] * (toxicity.WINDOW - len(x)) for x in wins])
    expected = toxicity.sigmoid(net.logits(ids, fx, bx)).max()
    assert toxicity.Scorer(net).scores([" ".join(words)])[0] == pytest.approx(expected, abs=1e-5)


def test_scores_are_those_of_plain_versions():
    """Texts in blocks, batches and pieces score as each does by itself, passage by passage, window by window."""
    g = random.Random(4)
    texts = [" ".join(g.choice(WORDS) for _ in range(n)) for n in (0, 1, 30, 300, 3000)] + ["x" * 2_500_000, "é" * 999, "a" * 1000]
    m = quality.Attention(256 + quality.STATS)
    m.mean, m.std = np.full(256 + quality.STATS, 0.01, np.float32), np.full(256 + quality.STATS, 0.3, np.float32)
    p = {k: v.astype(float) for k, v in m.p.items()}
    expected = []
    for t in texts:
        b = t.encode()
        x = np.concatenate([quality.features(np.frombuffer(b[i : i + 1000], np.uint8), np.array([len(b[i : i + 1000])])) for i in range(0, max(1, len(b)), 1000)])
        h = np.tanh((x - m.mean) / m.std @ p["W"] + p["b"])
        a = np.tanh(h @ p["V"]) / (1 + np.exp(-h @ p["U"])) @ p["w"]
        w = np.exp(a - a.max())
        expected.append(1 / (1 + np.exp(-(w / w.sum() @ h @ p["c"] + p["d"][0]))))
    assert m.scores([t.encode() for t in texts]) == pytest.approx(expected, abs=1e-4)

    net = toxicity.Network(WORDS, np.array([g.gauss(0, 2) for _ in WORDS]), np.zeros(toxicity.GRAMS))
    texts = texts[:5]

    def one(words):
        """A window step by step."""
        x = net.inputs(words or [""]).astype(float)
        states = []
        for k, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            h, out = np.zeros(toxicity.HIDDEN), [None] * len(x)
            for t in order:
                u, v = x[t] @ net.p[f"W{k}"] + net.p[f"B{k}"], h @ net.p[f"U{k}"]
                H = toxicity.HIDDEN
                z, r = 1 / (1 + np.exp(-(u[:H] + v[:H]))), 1 / (1 + np.exp(-(u[H : 2 * H] + v[H : 2 * H])))
                h = (1 - z) * np.tanh(u[2 * H :] + r * v[2 * H :]) + z * h
                out[t] = h
            states.append(np.array(out))
        h = np.concatenate(states, axis=1)
        e = np.tanh(h @ net.p["A"]) @ net.p["a"]
        e = np.exp(e - e.max())
        return 1 / (1 + np.exp(-((e / e.sum()) @ h @ net.p["o"] + net.p["c"][0])))

    expected = [max(one(t.split()[s : s + toxicity.WINDOW]) for s in toxicity.starts(len(t.split()))) for t in texts[1:]]
    assert toxicity.Scorer(net).scores(texts)[1:] == pytest.approx(expected, abs=1e-4)


def test_training_sample_is_bounded_by_whole_rows(spark):
    rows = [(i, "w " * (10 if i else 2000)) for i in range(40)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    of = lambda *bounds: [r["text"] for r in common.training_rows(docs, labels, "quality", *bounds).collect()]
    all_ = of(100, 1 << 20, 1 << 20)
    assert len(all_) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40))
    assert len(of(7, 1 << 20, 1 << 20)) == 7 and len(of(100, 101, 1000)) == 5 and all(t in dict(rows).values() for t in all_)


def test_features():
    out = quality.features(np.frombuffer(b"aa aa bAB c", np.uint8), np.array([5, 6]))
    assert out[0, 259] == pytest.approx(0.5) and out[0, 260] == pytest.approx(0.5) and out[1, 259] == 0
    assert quality.features(np.empty(0, np.uint8), np.array([0])).shape == (1, 256 + quality.STATS)
