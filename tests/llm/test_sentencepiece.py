"""Encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lexigauge.llm import sentencepiece_bpe as bpe

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.Codec(bpe.load(f.read()), kept=500)


CASES = ["", " ", "  two  spaces ", "hello world", "\n\t", "▁▁x▁", "日本語のテキスト", "🙂👩‍👩‍👧", "<s></s><unk><0x41>", "a" * 3000, "ab " * 3000, "x\0y", "naïve café", "ﬁ ½"]


@pytest.mark.parametrize("text", CASES)
def test_cases(codec, library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)


def test_random(codec, library):
    g = random.Random(4)
    for _ in range(1500):
        text = "".join(g.choice("abcdeEst \n▁éüñ漢字🙂.,*%#!0<>/x") for _ in range(g.randrange(50)))
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)
    for _ in range(1500):
        ids = [g.randrange(3, 32000) if g.random() < 0.6 else g.randrange(300) for _ in range(g.randrange(10))]
        assert codec.decode(ids) == library.decode(ids)


def test_prefix_table(codec):
    """The table's tokens are those of merging by the definition, for every prefix."""
    for word in ("▁internationalisation", "▁the", "▁aaaaaaaaab", "▁Straßenbahnhaltestelle"):
        last = codec.last_tokens(word)
        for i in range(1, len(word) + 1):
            assert (last[i] or 1) == len(codec.merged(word[:i])[-1])


def test_tables(spark, library):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, None), (3, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(df, PATH).collect())
    expected = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        expected.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(expected)
    tokens = bpe.encoded(df, PATH)
    assert sorted(r["text"] for r in bpe.decoded(tokens, PATH).collect()) == ["", "", "hello world", "hello world"]
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
