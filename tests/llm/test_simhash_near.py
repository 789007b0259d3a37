"""Sampled SimHash segments against all pairs."""

import random

import numpy as np
import pytest

from lexigauge.llm import simhash_near


def linked(a: bytes, b: bytes) -> bool:
    """The rule without an index: at most DISTANCE bits, and a segment that differs in one group of four bits at most."""
    if sum((x ^ y).bit_count() for x, y in zip(a, b)) > simhash_near.DISTANCE:
        return False
    return any(sum(x != y for x, y in zip(a[s : s + 4].hex(), b[s : s + 4].hex())) <= 1 for s in range(0, len(a), 4))


def brute(texts):
    """The least number that links reach, for each text."""
    fps = [simhash_near.signature(t or "") for t in texts]
    label = list(range(len(fps)))
    while True:
        new = [min(label[j] for j in range(len(fps)) if linked(fps[i], fps[j])) for i in range(len(fps))]
        if new == label:
            return label
        label = new


def documents(g):
    word = lambda: g.choice(["".join(g.choice("abcdefgh") for _ in range(4)) for _ in range(8)] + [str(g.randrange(10_000))])
    base = [[word() for _ in range(g.randrange(30, 120))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for _ in range(120):
        b = list(g.choice(base[:6]))
        for _ in range(g.randrange(0, 5)):
            b[g.randrange(len(b))] = word()
        texts.append(" ".join(b))
    return [*texts, "", None, "one two", "ONE  two", "a b c d e", "very long " * 20_000, "very long " * 20_000 + "end", texts[0]]


@pytest.mark.parametrize("crowded, batch", [(simhash_near.CROWDED, simhash_near.BATCH), (simhash_near.CROWDED, 3), (8, 3), (4, 2)])
def test_against_all_pairs(spark, monkeypatch, crowded, batch):
    """With whole groups, and with groups that come in many batches and are searched in parts."""
    monkeypatch.setattr(simhash_near, "BATCH", batch)
    searched = []
    linked_ = simhash_near.linked
    monkeypatch.setattr(simhash_near, "linked", lambda *a: searched.append(a[2]) or linked_(*a))
    texts = documents(random.Random(9))
    label = brute(texts)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, fp string, _own0 string")
    got = {r["doc_id"]: r["component_id"] for r in simhash_near.near_duplicates(df, crowded=crowded).collect()}
    assert got == dict(enumerate(label))
    assert (len(searched) > 1) == (crowded < 10)  # parts are searched where groups are too large
    assert len(set(label)) < len(label) - 60
    kept = simhash_near.keep_one(df, crowded=crowded)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "c d"), (3, "c d"), (3, "c d"), (4, None), (5, "")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in simhash_near.near_duplicates(df).collect())
    assert got == [("3", "3"), ("3", "3"), ("4", "4"), ("5", "4"), ("None", "3"), ("None", "None")]
    assert sorted(str(r["doc_id"]) for r in simhash_near.keep_one(df).collect()) == ["3", "4", "None"]
    assert simhash_near.near_duplicates(df.limit(0)).count() == simhash_near.keep_one(df.limit(0)).count() == 0


def test_similar_sets_are_linked():
    """Random pairs of sets of shingles: nearly all of a similarity of 0.9 are linked, most of 0.8, none of 0.3."""
    g = random.Random(1)

    def share(similarity, n=150):
        hits = 0
        for _ in range(n):
            words = [str(g.randrange(10**9)) for _ in range(300)]
            other = list(words)
            edits = round(300 * (1 - similarity) / (1 + similarity) / 5)
            for k in g.sample(range(0, 300, 5), edits):
                other[k] = "x"
            hits += linked(simhash_near.signature(" ".join(words)), simhash_near.signature(" ".join(other)))
        return hits / n

    assert share(0.9) > 0.95 and share(0.8) > 0.6 and share(0.3) == 0


def test_signature():
    assert simhash_near.signature("A b C d e f") == simhash_near.signature("a  b\tc d e f") != simhash_near.signature("a b c d e g")
    assert simhash_near.signature("") == bytes(32) and len(simhash_near.shingle_hashes("a b c d e f")) == 2
    x = np.frombuffer(simhash_near.signature("a b c"), np.uint64)
    assert simhash_near.near(x, x[None, :]).all()
