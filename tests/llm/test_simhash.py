"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from lexigauge.llm import simhash
from lexigauge.llm.common import Scratch, components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(fps):
    """The least index reachable of each fingerprint."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 3 and label[j] > label[i]:
                    label[j] = label[i]
                    changed = True
    return label


@pytest.mark.parametrize("text", ["", "   \n", "one", "Two words", "A b C d e", "É É É é x", "x　y z w v u t", "a " * 5000 + "b c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_forest():
    g = random.Random(3)
    fps = sorted({g.getrandbits(64) ^ sum(1 << g.randrange(64) for _ in range(g.randrange(4))) for _ in range(3) for _ in range(1)} | {(5 << 40) ^ (1 << g.randrange(12)) ^ (1 << g.randrange(12)) for _ in range(60)})
    a, b = simhash.forest(np.array(fps, np.uint64))
    assert all((x ^ y).bit_count() <= 3 for x, y in zip(a, b))
    label = {f: f for f in fps}
    for _ in fps:
        for x, y in zip(a, b):
            label[x] = label[y] = min(label[x], label[y])
    expected = brute(fps)
    assert [label[f] for f in fps] == [fps[k] for k in expected]


@pytest.mark.parametrize("crowded", [simhash.CROWDED, 5])
def test_links(spark, crowded):
    """All pairs of clusters of different tightness, with crowded keys sent to the second level or not."""
    g = random.Random(9)
    centres = [g.getrandbits(64) for _ in range(12)]
    fps = {c ^ sum(1 << b for b in g.sample(range(64), g.randrange(5))) for c in centres for _ in range(15)} | {0, 1, 7, (1 << 64) - 1}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    scratch = Scratch(spark, "test")
    found = simhash.links(scratch, spark.createDataFrame([(s,) for s in signed], "fp long"), crowded)
    root = {r["node"]: r["root"] for r in components(scratch, found).collect()}
    got = [root.get(s, s) for s in signed]
    label = brute(fps)
    assert all((got[i] == got[j]) == (label[i] == label[j]) for i in range(len(fps)) for j in range(i))


def test_documents(spark):
    rows = [(3, "a b c d e f", "en"), (1, "A B C d e f", "x"), (2, None, None), (7, "", "x"), (None, "  ", None), (9, "z " * 30000, "y"), (4, "other words here now", "y"), (4, "other words here now", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 2), (1, 1), (2, 2), (3, 1), (4, 4), (4, 4), (7, 2), (9, 9)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 9]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0
    assert simhash.keep_one(spark.createDataFrame([(None, "x"), (None, "x"), (None, "y z")], "doc_id long, text string")).count() == 2


def test_components(spark):
    """A path, a star, a loop and a long chain with shuffled names."""
    g = random.Random(1)
    names = g.sample(range(-(10**6), 10**6), 300)
    edges = [(names[i], names[i + 1]) for i in range(100)] + [(names[150], names[i]) for i in range(151, 220)] + [(5_000_000, 5_000_000)]
    got = {r["node"]: r["root"] for r in components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[names[i]] for i in range(101)}) == 1 and len({got[names[i]] for i in range(150, 220)}) == 1
    assert got[names[0]] != got[names[151]] and 5_000_000 not in got
