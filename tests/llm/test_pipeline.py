"""The pipeline against its stages in plain Python, and on odd tables."""

import random

import pytest

import corpus_pipeline
from lexigauge.llm import packing, quality, toxicity

from .test_classifiers import corpus
from .test_simhash_near import brute as near
from .test_suffixes import brute

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    g = random.Random(3)
    rows = corpus(400, 5)
    passage = " ".join(g.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(60))
    texts = {i: t for i, t, _, _ in rows}
    for i in (11, 12, 13):
        texts[i] = texts[10]
    for i in (30, 31):
        texts[i] = texts[i] + " " + passage
    docs = [(i, t, "en", "s", len(t)) for i, t in texts.items()] + [(900, None, None, None, None), (901, "", "en", "s", 0), (10, texts[10], "en", "s", len(texts[10])), (None, "house tree river stone", None, None, None)]
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, q, t) for i, _, q, t in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")


def test_against_plain(spark, folder):
    """Each stage's decisions by the operators' own functions, row by row."""
    docs = sorted((r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()), key=key)
    frame = lambda rows: spark.createDataFrame([tuple(r[c.split()[0]] for c in DOCUMENTS.split(", ")) for r in rows], DOCUMENTS)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = quality.train(frame(docs), labels).scores([(r["text"] or "").encode() for r in docs])
    docs = [r for r, s in zip(docs, good) if s >= 0.3]
    bad = toxicity.Scorer(toxicity.train(frame(docs), labels)).scores([r["text"] or "" for r in docs])
    docs = [r for r, s in zip(docs, bad) if s < 0.5]
    label = near([r["text"] for r in docs])
    docs = [r for i, r in enumerate(docs) if label[i] == i]  # sorted by id: the first of a component has its least id
    left = [x[0].decode("utf-8", "ignore") for x in brute([(r["text"] or "").encode() for r in docs], 200)]
    expected = sorted((str(r["doc_id"]), k, min(2048, len(t.split()) - 2048 * k)) for r, t in zip(docs, left) for k in range(max(1, -(-len(t.split()) // 2048))))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["n_tokens"]) for r in got) == expected
    texts = {}
    for r in sorted(got, key=lambda r: r["piece"]):
        texts[str(r["doc_id"])] = texts.get(str(r["doc_id"]), "") + r["text"]
    assert texts == {str(r["doc_id"]): t for r, t in zip(docs, left)}  # what is left of each text, whole
    counts = {}
    for r in got:
        counts[r["n_tokens"]] = counts.get(r["n_tokens"], 0) + 1
    assert sum(r["padding"] for r in got) == packing.padding(counts, packing.boundaries(counts))


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0
