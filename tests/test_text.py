"""Texts: sentences, Markdown, metrics, rewriting, delimiters."""

import pytest
from pyspark.sql import functions as F

from lexigauge.functions import compat, lint, text, tokens
from lexigauge.session import spread


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given, expected",
    [
        ("これは文です。これも文です！これは？最後", ["これは文です。", "これも文です！", "これは？", "最後"]),
        ("「はい。」と言った。", ["「はい。」", "と言った。"]),
        ("", []),
        ("One. Two! Three", ["One. Two!", "Three"]),
        ("一。\n\n　二 \n三", ["一。", "二", "三"]),
        ("本当？！", ["本当？", "！"]),
    ],
)
def test_sentences(spark, given, expected):
    assert value(spark, text.split_sentences(text.strip_markdown(F.col("t"))), t=given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("a\n```\ncode\n```\nb", "a\n\nb"),
        ("a\n~~~~\n~~~\ncode\n~~~~\nb", "a\n\nb"),
        ("a\n```\nopen", "a"),
        ("a\n\n    code\n\n    more\nb", "a\n\n\nb"),
        ("a\n    not code", "a\n    not code"),
        ("- item\n\n    inside", "- item\n\n    inside"),
        ("- item\n\n      code\n\nout", "- item\n\n\nout"),
        ("> ```\n> x\n> ```\nb", "\nb"),
        ("1. a\n   - b\n\n     text", "1. a\n   - b\n\n     text"),
        ("-     five\n\n  text", "-     five\n\n  text"),
    ],
)
def test_code_blocks(spark, given, expected):
    assert value(spark, text.remove_code_blocks(F.col("t")), t=given) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("use `x` and ``a `b` c``", "use X and X"),
        ("## Title", "Title"),
        ("Title\n===\nbody", "Title\n\nbody"),
        ("* one\n2) two", "one\ntwo"),
        ("| a | b |\n| --- | :-: |\n| c | d |", " a b \n\n c d "),
        ("**bold** [label](url)", "bold label"),
    ],
)
def test_markdown(spark, given, expected):
    assert value(spark, text.strip_markdown(F.col("t")), t=given) == expected


def test_surface(spark):
    given = "見出し\n===\n\n本文です。次の文です。\n\n| a |\n|---|\n\n- 項目\n- 項目二"
    row = text.with_surface(spark.createDataFrame([(given,), ("",), ("```\ncode\n```",), ("𠮷野、あ、い、う、え。",)], "text string")).collect()
    assert row[0]["headings"] == 1 and row[0]["listLines"] == 2 and row[0]["sentences"] == 6
    assert row[1]["sentences"] == 0 and row[1]["chars"] == 0 and row[1]["meanSentenceLength"] == 0.0
    assert row[2]["chars"] == 0
    assert row[3]["chars"] == 12 and row[3]["manyTenRatio"] == 1.0  # a character beyond the basic plane counts twice


def test_rewrite(spark):
    given = "- することができます\n設定を行います。便利ですが、高い。"
    assert value(spark, text.rewrite(F.col("t")), t=given) == "- することができます\n設定します。便利です。高い。"


@pytest.mark.parametrize("given, length", [("|" + "---|" * 20_000, 0), (">" * 100_000 + " x", 100_001), ("a\n\n    code\n" + "    more\n" * 100_000 + "end", 7), ("\n".join(["```", "x", "```", "y"] * 25_000), 74_999)])
def test_very_long_texts(spark, given, length):
    """Neither a line of marks nor a wide table's rule ends the JVM, and many lines take time in proportion."""
    assert value(spark, F.length(text.strip_markdown(F.col("t"))), t=given) == length


def test_delimiters(spark):
    given = "a </text> <text_a> </TEXT_B > <b>"
    assert value(spark, text.escape_delimiters(F.col("t"), ["text", "text_a", "text_b"]), t=given) == "a &lt;/text&gt; &lt;text_a&gt; &lt;/TEXT_B &gt; <b>"
    assert value(spark, text.tagged(F.col("t"), "x"), t="<x>\na\n</x><x>b</x>") == "a"
    assert value(spark, text.delimiter_tags(F.col("t"), ["text"]), t="</text></more></a-b >") == ["text", "more", "a-b"]


def test_numbers(spark):
    df = spark.createDataFrame([(-2.5,), (1.005,), (2.5,)], "x double")
    assert [r[0] for r in df.select(compat.round_half_up(F.col("x"), 0)).collect()] == [-2.0, 1.0, 3.0]
    assert compat.draws(42, 3) == pytest.approx([0.6011037519, 0.4482905590, 0.8524657935])
    drawn = spark.range(3).select(compat.random_draw(F.lit(42), F.col("id")).alias("r")).collect()
    assert [r[0] for r in drawn] == compat.draws(42, 3)
    assert sorted(compat.permutation(10, 7)) == list(range(10)) and compat.permutation(10, 7) == compat.permutation(10, 7)


def test_lint(spark):
    given = "設定を行うことを、あれ、これ、それ、どれ、する。東京都立中央図書館。\n```\nを行う\n```"
    rows = lint.with_lint(spark.createDataFrame([(given,), (None,)], "text string"), "text", "m").select(lint.rule_counts(F.col("m")).alias("n")).collect()
    assert rows[0]["n"] == {"max-ten": 1, "max-kanji-run": 1, "no-redundant-expression": 1} and rows[1]["n"] == {}
    fixed = value(spark, lint.fix(F.col("t")), t="設定を行う。")
    assert fixed["text"] == "設定する。" and fixed["applied"] == 1 and fixed["remaining"] == 0


def test_tokenizer_plug_in(spark):
    """An analyser in Python, in Arrow batches, feeds the same metrics."""
    import pandas as pd

    words = {"走ら": ("走る", "動詞", "自立"), "れる": ("れる", "動詞", "接尾"), "馬": ("馬", "名詞", "一般"), "は": ("は", "助詞", "係助詞"), "。": ("。", "記号", "句点")}

    @F.pandas_udf("array<struct<surface_form:string,basic_form:string,pos:string,pos_detail_1:string>>")
    def analyse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("surface_form", "basic_form", "pos", "pos_detail_1"), (w, *words[w]))) for w in t.split()])

    rows = tokens.token_rows(spark.createDataFrame([(1, "馬 は 走ら れる 。")], "sampleId int, plain string"), analyse)
    got = tokens.token_metrics(rows, spark.createDataFrame([(1, 1, 6.0)], "sampleId int, sentences int, meanSentenceLength double")).first()
    assert (got["tokens"], got["verbRatio"], got["particleRatio"], got["rareruPerSentence"], got["typeTokenRatio"]) == (4, 0.5, 0.25, 1.0, 1.0)


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 8 and spread(spark.range(100, numPartitions=20)).rdd.getNumPartitions() == 20


def test_tokenizer(spark):
    rows = tokens.token_rows(spark.createDataFrame([(1, "東京は雨です。")], "sampleId int, plain string")).orderBy("ord").collect()
    assert [r["surface_form"] for r in rows] == ["東京", "は", "雨", "です", "。"]
