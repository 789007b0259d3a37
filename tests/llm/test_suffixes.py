"""Induced sorting and passage removal against brute force."""

import gc
import hashlib
import random
import shutil
import tempfile
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from lexigauge.llm import induced_sort, suffix_dedup


def common(text, a, b, limit):
    n = 0
    while n < limit and max(a, b) + n < len(text) and text[a + n] == text[b + n]:
        n += 1
    return n


@pytest.mark.parametrize("memory", [1 << 20, 16, 5])
def test_order(memory):
    """Order and common prefixes, in memory and with queues and sorters on disk."""
    g = random.Random(memory)
    for _ in range(120):
        letters, text = g.choice([2, 3, 5, 200]), []
        for _ in range(g.randrange(1, 4)):
            text += [g.randrange(1, letters + 1) for _ in range(g.randrange(1, 60))] + [0]
            if g.random() < 0.5:
                text = text[:-1] + text[:-1] * g.randrange(3) + [0]
        limit, data = g.choice([3, 8, 20, 100]), bytes(text)
        with induced_sort.Disk(memory) as disk:
            pieces: dict[int, list] = {}
            for pos, lcp in induced_sort.order(np.array(text, np.uint8), limit, disk):
                pieces.setdefault(text[pos[0]], []).append((pos, lcp))
        order = [int(p) for c in sorted(pieces) for pos, _ in pieces[c] for p in pos]
        prefix = [int(x) for c in sorted(pieces) for _, lcp in pieces[c] for x in lcp]
        assert sorted(order) == list(range(len(text)))
        for i in range(1, len(order)):
            assert data[order[i - 1] :][:limit] <= data[order[i] :][:limit]
            assert prefix[i] == common(text, order[i - 1], order[i], limit)


def peak_of_sorting(n, memory):
    """Megabytes that sorting a text of n characters with repeats holds at once beside its files."""
    g = np.random.default_rng(n)
    path = tempfile.mkdtemp()
    text = np.memmap(f"{path}/text", np.uint8, "w+", shape=(n,))
    for a in range(0, n, 1 << 16):
        text[a : a + (1 << 16)] = g.integers(1, 60, min(1 << 16, n - a), dtype=np.uint8)
    copies = n // 20
    text[n // 2 : n // 2 + copies] = text[:copies]
    text[np.arange(499, n, 500)] = 0
    text[-1] = 0
    with induced_sort.Disk(memory) as disk:
        gc.collect()
        tracemalloc.start()
        hit = induced_sort.repeats(text, 200, disk)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        found = np.flatnonzero(hit)
    inside = np.arange(copies) % 500 < 300 - 1
    assert set(found) >= set(np.flatnonzero(inside)) | set(n // 2 + np.flatnonzero(inside & (np.arange(copies) + 200 <= copies))) - set(range(copies - 700, n // 2)) - set(range(n // 2 + copies - 700, n))
    shutil.rmtree(path)
    return peak


def test_memory_does_not_grow_with_the_text():
    """A text of four times the length, over a hundred times what may be in memory, takes no more memory."""
    small, large = peak_of_sorting(500_000, 1 << 13), peak_of_sorting(2_000_000, 1 << 13)
    assert large < 1.3 * small and large < 12


def brute(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((bytes(b for b, x in zip(t, gone) if not x), sum(gone), sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))))
    return out


def test_pieces_cover_all_strings():
    g = random.Random(2)
    data = np.frombuffer(bytes(g.choice(b"abcd ") for _ in range(3000)), np.uint8)
    gram, start, number = suffix_dedup.pieces(data, 200)
    assert start[0] == 0 and (start[1:] == start[:-1] + number[:-1]).all() and start[-1] + number[-1] == 3000 - 199
    again = suffix_dedup.pieces(data[500:], 200)  # a string's gram depends on the string alone
    of = lambda p, i: p[0][np.searchsorted(p[1], i, "right") - 1]
    assert all(of((gram, start, number), i + 500) == of(again, i) for i in range(2000))


def documents(g):
    base = ["".join(g.choice("abcdefg é") for _ in range(g.randrange(300, 900))) for _ in range(8)]
    shared = "".join(g.choice("shared pasge") for _ in range(260))
    texts = [*base, base[0], base[0], base[1][:400] + "x" + base[1][400:], base[2] + shared, shared + base[3], base[4][:150] + shared[:250] + base[4][150:], "ab" * 300, "the the " * 100, "short", "", None, base[5][:199], base[5][:200], "é" * 150]
    return [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)]


@pytest.mark.parametrize("shard, crowded", [(suffix_dedup.SHARD, suffix_dedup.CROWDED), (2000, 1)])
def test_documents(spark, shard, crowded):
    """In one shard and in many, and with every gram sent through further rounds."""
    rows = documents(random.Random(6))
    df = spark.createDataFrame(rows, "doc_id long, text string, tk string")
    texts = [(t or "").encode() for _, t, _ in rows]
    expected = sorted((str(i), len(b), gone, n, hashlib.sha256(left).hexdigest()) for (i, _, _), b, (left, gone, n) in zip(rows, texts, brute(texts, 200)))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(df, shard=shard, crowded=crowded).collect())
    assert got == expected
    kept = suffix_dedup.keep(df)
    assert kept.columns == df.columns
    left = sorted((str(i), left.decode("utf-8", "ignore") if t is not None else "null") for (i, t, _), (left, _, _) in zip(rows, brute(texts, 200)))
    assert sorted((str(r["doc_id"]), r["text"] if r["text"] is not None else "null") for r in kept.collect()) == left
    assert suffix_dedup.digest(df.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexigauge_texts_")]


def test_clashing_names(spark):
    names = ["doc_id", "text", "tk", "spans", "left_text", "row_tk", "_own0", "_OWN1"]
    df = spark.createDataFrame([(1, "a" * 300, *"abcdef"), (2, "b", *"ghijkl"), (None, None, *"mnopqr")], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = sorted(map(str, suffix_dedup.keep(df).collect()))
    assert got == sorted(map(str, [r if r["doc_id"] != 1 else type(r)(**(r.asDict() | {"text": ""})) for r in df.collect()]))


def test_shards_in_files(spark, monkeypatch):
    """Pieces, their numbers and the sorting in files give the same."""
    monkeypatch.setattr(suffix_dedup.Disk.__init__, "__defaults__", (64,))
    g = random.Random(3)
    texts = [bytes(g.choice(b"abc ") for _ in range(g.randrange(20, 400))) for _ in range(30)]
    texts += [t[10:] for t in texts[:10]]
    disk = suffix_dedup.Disk(16)
    shard = suffix_dedup.Shard(disk, 2)
    for k, t in enumerate(texts):
        shard.add(t, k, -k)
    got = list(shard.repeats(50))
    seen = Counter(t[i : i + 50] for t in texts for i in range(len(t) - 49))
    assert [n for n, _ in got] == [[k, -k] for k in range(len(texts))]
    for (_, spans), t in zip(got, texts):
        assert [i for a, b in spans for i in range(a, b)] == [i for i in range(len(t) - 49) if seen[t[i : i + 50]] > 1]
    disk.close()


def test_common_passage_in_differing_surroundings(spark, monkeypatch):
    """A passage shorter than the strings that all documents have leaves no crowded gram: none of its groups grows with the corpus."""
    sizes = []
    cut = suffix_dedup.Scratch.cut

    def watched(self, df, label="t", *rows):
        out = cut(self, df, label, *rows)
        if label == "crowded":
            sizes.append(sum(r["count"] for r in out.groupBy().count().collect()))
        return out

    monkeypatch.setattr(suffix_dedup.Scratch, "cut", watched)
    g = random.Random(4)
    word = lambda n: "".join(g.choice("abcdefghijklmnop ") for _ in range(n))
    passage = word(190)
    texts = [word(g.randrange(250, 300)) + passage + word(g.randrange(250, 300)) for _ in range(300)]
    texts[7] = texts[3][:520] + texts[7][520:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(df, crowded=40).collect()}
    assert got == {i: (len(t), gone, n, hashlib.sha256(left).hexdigest()) for i, (t, (left, gone, n)) in enumerate(zip(texts, brute([t.encode() for t in texts], 200)))}
    assert got[3][1] >= 500 and sizes[0] > 0 and sizes[-1] == 0
