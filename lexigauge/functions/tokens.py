"""Metrics over words with parts of speech.

A tokenizer is a plug-in: a function of a text column that gives ARRAY<STRUCT<surface_form, basic_form, pos,
pos_detail_1>>, native or an Arrow UDF around an analyser. scripts() is a deterministic stand-in that cuts at changes of
script and guesses no part of speech but particles and verb endings; its values are not those of an analyser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .compat import WS, trim
from .text import HIRAGANA, KANJI, KATAKANA

#: Names of parts of speech, and the weights of the readability formula.
SYMBOL, FILLER, OTHER, NOUN, PREFIX, VERB, PARTICLE = "記号", "フィラー", "その他", "名詞", "接頭詞", "動詞", "助詞"
NUMBER, VERBAL_NOUN, SUFFIX = "数", "サ変接続", "接尾"
PASSIVE = ("れる", "られる")
INTERCEPT, LENGTH, KANGO, WAGO, VERBS, PARTICLES = 11.724, 0.056, 0.126, 0.042, 0.145, 0.044

PARTICLE_WORDS = ("が", "の", "を", "に", "へ", "と", "で", "から", "まで", "より", "は", "も", "や", "か", "ね", "よ")


def origin(surface: Column, pos: Column, detail: Column) -> Column:
    """kango, wago, gairaigo or other: where a word comes from, by its script and part of speech."""
    all_kanji = surface.rlike(f"^[{KANJI}]+$")
    return (
        F.when(pos.isin(SYMBOL, FILLER, OTHER), "other")
        .when(surface.rlike("^[0-9０-９.,]+$"), "other")
        .when(surface.rlike(f"^[{KATAKANA}]+$") | surface.rlike("^[A-Za-z0-9]+$"), "gairaigo")
        .when((pos == NOUN) & (detail == NUMBER), F.when(all_kanji, "kango").otherwise("other"))
        .when(pos.isin(NOUN, PREFIX) & ((detail == VERBAL_NOUN) | all_kanji & (F.length(surface) >= 2)), "kango")
        .otherwise("wago")
    )


def readability(mean_length: Column, kango: Column, wago: Column, verbs: Column, particles: Column) -> Column:
    """The formula over a mean sentence length and percentages of words."""
    return F.lit(INTERCEPT) - mean_length * LENGTH - kango * KANGO - wago * WAGO - verbs * VERBS - particles * PARTICLES


def token_metrics(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """Per text, from token rows (sampleId, surface_form, basic_form, pos, pos_detail_1) and (sampleId, sentences, meanSentenceLength). Texts without tokens have zeros and no readability."""
    words = tokens.filter((F.col("pos") != SYMBOL) & (trim(F.col("surface_form")) != ""))
    kind = origin(F.col("surface_form"), F.col("pos"), F.col("pos_detail_1"))
    passive = (F.col("pos") == VERB) & (F.col("pos_detail_1") == SUFFIX) & F.col("basic_form").isin(*PASSIVE)
    grouped = words.withColumn("kind", kind).groupBy("sampleId").agg(
        F.count("*").alias("tokens"),
        F.count_distinct(F.when(F.col("basic_form") == "*", F.col("surface_form")).otherwise(F.col("basic_form"))).alias("types"),
        *[F.count_if(c).alias(n) for n, c in (("kango", F.col("kind") == "kango"), ("wago", F.col("kind") == "wago"), ("verbs", F.col("pos") == VERB), ("particles", F.col("pos") == PARTICLE), ("rareru", passive))],
    )
    joined = sentences.join(grouped, "sampleId", "left").fillna(0, ["tokens", "types", "kango", "wago", "verbs", "particles", "rareru"])
    total, n = F.greatest(F.col("tokens"), F.lit(1)).cast("double"), F.greatest(F.col("sentences"), F.lit(1)).cast("double")
    share = lambda c: F.col(c) / total
    score = readability(F.col("meanSentenceLength"), share("kango") * 100, share("wago") * 100, share("verbs") * 100, share("particles") * 100)
    return joined.select(
        "sampleId", "tokens", (F.col("tokens") / n).alias("tokensPerSentence"), share("types").alias("typeTokenRatio"), share("kango").alias("kangoRatio"), share("wago").alias("wagoRatio"), share("verbs").alias("verbRatio"),
        share("particles").alias("particleRatio"), F.when((F.col("sentences") > 0) & (F.col("tokens") > 0), score).alias("jreadability"), (F.col("rareru") / n).alias("rareruPerSentence"),
    )


def scripts(text: Column) -> Column:
    """The stand-in tokenizer: runs of one script. Approximate; for relative use only."""
    runs = F.regexp_extract_all(text, F.lit(f"[{KANJI}]+|[{KATAKANA}]+|[{HIRAGANA}]+|[A-Za-z0-9]+|[^{KANJI}{KATAKANA}{HIRAGANA}A-Za-z0-9{WS[1:-1]}]"), F.lit(0))
    pos = lambda x: F.when(x.isin(*PARTICLE_WORDS), PARTICLE).when(x.rlike(f"^[{HIRAGANA}]+(る|た|ます|です)$"), VERB).when(x.rlike(f"^[{KANJI}{KATAKANA}{HIRAGANA}A-Za-z0-9]+$"), NOUN).otherwise(SYMBOL)
    return F.transform(runs, lambda x: F.struct(x.alias("surface_form"), x.alias("basic_form"), pos(x).alias("pos"), F.lit("*").alias("pos_detail_1")))


#: What names the tokenizer and its version in the hash of a scoring; a plug-in gives its own.
TOKENIZER = "scripts-1"


def token_rows(texts: DataFrame, tokenizer=scripts) -> DataFrame:
    """Token rows of (sampleId, plain)."""
    return texts.select("sampleId", F.posexplode(tokenizer(F.col("plain"))).alias("ord", "t")).select("sampleId", "ord", "t.*")
