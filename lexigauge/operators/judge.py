"""Judging of samples: requests, a cache of answers, rubric and pairwise verdicts.

A judge is asked once for each distinct request, whatever number of samples need the answer: requests are made distinct
and those with an answer left out before the judge runs, since the optimiser cannot know that asking twice is waste.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import hashed
from ..functions.text import escape_delimiters, with_heuristic
from ..schema import DEFAULT_AUDIENCE, PAIRWISE_VERSION, RUBRIC_KEYS, RUBRIC_VERSION
from ..sources.providers import provider_for
from ..tables import written
from .report import combine, flip

TAGS = ["text", "text_a", "text_b"]

RUBRIC_PROMPT = "Rate how easy the text in <text> is to read for {audience}. The task was: {title}. Give readability, clarity, naturalness, concision, structure and overall from 1 to 5, with a reason.\n<text>\n{text}\n</text>"
PAIRWISE_PROMPT = "Say which of the two texts is easier to read for {audience}: A, B or tie, with a reason. The task was: {title}.\n<text_a>\n{a}\n</text_a>\n<text_b>\n{b}\n</text_b>"


def context_hash(title: Column, audience: Column) -> Column:
    return hashed("context", title, F.coalesce(audience, F.lit(DEFAULT_AUDIENCE)))


def _filled(template: str, **values: Column) -> Column:
    """The template with columns in place of its {names}; a column's own braces stay as they are."""
    parts, rest = [], template
    while (at := rest.find("{")) >= 0:
        end = rest.index("}", at)
        parts += [F.lit(rest[:at]), values[rest[at + 1 : end]]]
        rest = rest[end + 1 :]
    return F.concat(*parts, F.lit(rest))


def rubric_prompt(title: Column, audience: Column, text: Column) -> Column:
    return _filled(RUBRIC_PROMPT, title=title, audience=F.coalesce(audience, F.lit(DEFAULT_AUDIENCE)), text=escape_delimiters(text, TAGS))


def pairwise_prompt(title: Column, audience: Column, a: Column, b: Column) -> Column:
    return _filled(PAIRWISE_PROMPT, title=title, audience=F.coalesce(audience, F.lit(DEFAULT_AUDIENCE)), a=escape_delimiters(a, TAGS), b=escape_delimiters(b, TAGS))


SYSTEM = "You judge how easy texts are to read and to understand, not whether what they say is right or how much they say. Length alone is neither good nor bad."
RUBRIC_SCHEMA = {"type": "object", "additionalProperties": False, "required": [*RUBRIC_KEYS, "rationale"], "properties": {k: {"type": "integer", "minimum": 1, "maximum": 5} for k in RUBRIC_KEYS} | {"rationale": {"type": "string"}}}
PAIRWISE_SCHEMA = {"type": "object", "additionalProperties": False, "required": ["verdict", "rationale"], "properties": {"verdict": {"type": "string", "enum": ["A", "B", "tie"]}, "rationale": {"type": "string"}}}
RUBRIC_ANSWER = f"cacheKey string, scores struct<{', '.join(f'{k}:int' for k in RUBRIC_KEYS)}>, rationale string"
PAIRWISE_ANSWER = "cacheKey string, verdict string, rationale string"


def config_hash(model: dict) -> str:
    """What a judge's verdicts depend on: its configuration without its id and label."""
    return hashlib.sha256(json.dumps({k: v for k, v in model.items() if k not in ("id", "label")}, ensure_ascii=False, sort_keys=True).encode()).hexdigest()


def checked(answer: dict, schema: dict) -> dict:
    """answer if it has the schema's fields, of the right kinds and ranges."""
    for name, kind in schema["properties"].items():
        x = answer.get(name)
        ok = isinstance(x, str) and x in kind.get("enum", [x]) if kind["type"] == "string" else isinstance(x, int) and not isinstance(x, bool) and kind["minimum"] <= x <= kind["maximum"]
        if not ok:
            raise ValueError(f"{name} cannot be {x!r}")
    return answer


def asked(requests: DataFrame, model: dict, schema: dict, parallel: int | None = None) -> DataFrame:
    """(cacheKey, answer, error) for (cacheKey, prompt): the answer of the model's provider as JSON, or what it raised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, prompt in zip(rows["cacheKey"], rows["prompt"]):
                try:
                    out.append((key, json.dumps(checked(provider_for(model).generate_json(SYSTEM, prompt, schema), schema), ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001
                    out.append((key, None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["cacheKey", "answer", "error"])

    rows = requests.select("cacheKey", "prompt")
    return (rows.repartition(parallel) if parallel else rows).mapInPandas(run, "cacheKey string, answer string, error string")


def rubric_answers(model: dict, parallel: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """The `answer` of judge_rubric() that asks a model; the mock one answers by the heuristic. Failed requests keep their error."""
    if model["provider"] == "mock":
        return lambda df: with_mock_scores(df, "text", "scores").select("cacheKey", "scores", F.lit("mock").alias("rationale"), F.lit(None).cast("string").alias("error"))

    def answer(df: DataFrame) -> DataFrame:
        made = asked(df.withColumn("prompt", rubric_prompt(F.col("title"), F.col("audience"), F.col("text"))), model, RUBRIC_SCHEMA, parallel)
        parsed = F.from_json("answer", ", ".join(f"{k} int" for k in RUBRIC_KEYS) + ", rationale string")
        return made.withColumn("p", parsed).select("cacheKey", F.when(F.col("p").isNotNull(), F.struct(*[F.col(f"p.{k}").alias(k) for k in RUBRIC_KEYS])).alias("scores"), F.col("p.rationale").alias("rationale"), "error")

    return answer


def pairwise_answers(model: dict, parallel: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """The `answer` of judge_pairwise() that asks a model."""
    if model["provider"] == "mock":
        return lambda df: with_heuristic(with_heuristic(df, "x", "hx"), "y", "hy").select("cacheKey", mock_verdict(F.col("hx"), F.col("hy")).alias("verdict"), F.lit("mock").alias("rationale"), F.lit(None).cast("string").alias("error"))

    def answer(df: DataFrame) -> DataFrame:
        made = asked(df.withColumn("prompt", pairwise_prompt(F.col("title"), F.col("audience"), F.col("x"), F.col("y"))), model, PAIRWISE_SCHEMA, parallel)
        return made.withColumn("p", F.from_json("answer", "verdict string, rationale string")).select("cacheKey", "p.verdict", "p.rationale", "error")

    return answer


def cached(requests: DataFrame, cache: DataFrame | None, answer: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers for all requests, answers that are new). requests: (cacheKey, …); answer adds columns to distinct requests; cache has answer's columns, but error."""
    distinct = requests.dropDuplicates(["cacheKey"])
    new = written(answer(distinct if cache is None else distinct.join(cache, "cacheKey", "left_anti")))
    return (new if cache is None else new.unionByName(cache, allowMissingColumns=True)), new


def with_mock_scores(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with rubric scores by the heuristic, 1 to 5."""
    scored = with_heuristic(df, text, "_h").withColumn("_s", F.greatest(F.lit(1), F.least(F.lit(5), F.floor(1 + F.col("_h") / 100.0 * 4 + 0.5))).cast("int"))
    return scored.withColumn(out, scores_of(F.col("_s"))).drop("_h", "_s")


def scores_of(s: Column) -> Column:
    return F.struct(s.alias("readability"), s.alias("clarity"), F.least(F.lit(5), s + 1).alias("naturalness"), s.alias("concision"), F.greatest(F.lit(1), s - 1).alias("structure"), s.alias("overall"))


def mock_verdict(ha: Column, hb: Column) -> Column:
    """Which heuristic is higher; a difference below 3 is a tie."""
    return F.when(F.abs(ha - hb) < 3, "tie").when(ha > hb, "A").otherwise("B")


def rubric_requests(samples: DataFrame, sources: DataFrame, judge_hash: str) -> DataFrame:
    """samples: (sampleId, sourceId, text); sources: (sourceId, title, audience)."""
    joined = samples.join(sources, "sourceId", "left").withColumn("title", F.coalesce("title", "sourceId"))
    key = hashed("rubric", judge_hash, RUBRIC_VERSION, F.col("title"), F.coalesce("audience", F.lit(DEFAULT_AUDIENCE)), F.col("text"))
    return joined.withColumn("cacheKey", key)


Answers = Callable[[DataFrame], DataFrame]


def judge_rubric(samples: DataFrame, sources: DataFrame, judge_model: str, judge_hash: str, answer: Answers, cache: DataFrame | None = None, share: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rubric judgments and errors, answers that are new). answer takes distinct (cacheKey, title, audience, text) and returns (cacheKey, scores, rationale, error).

    share: equal requests are one, and the cache is used; else each sample is judged on its own.
    """
    requests = rubric_requests(samples, sources, judge_hash)
    if not share:
        requests, cache = requests.withColumn("cacheKey", hashed(F.col("cacheKey"), F.col("sampleId"))), None
    answers, new = cached(requests.select("cacheKey", "title", "audience", "text"), cache, answer)
    return requests.join(answers, "cacheKey").select(
        F.lit("rubric").alias("kind"), "sampleId", F.sha2("text", 256).alias("textHash"), "sourceId", context_hash(F.col("title"), F.col("audience")).alias("contextHash"),
        F.lit(judge_hash).alias("judgeConfigHash"), F.lit(judge_model).alias("judgeModel"), F.lit(RUBRIC_VERSION).alias("promptVersion"), "scores", "rationale", created().alias("createdAt"), "error",
    ), new


def judge_pairwise(pairs: DataFrame, sources: DataFrame, judge_model: str, judge_hash: str, answer: Answers, cache: DataFrame | None = None, share: bool = True) -> tuple[DataFrame, DataFrame]:
    """(pairwise judgments of both orders and errors, answers that are new). pairs: (scheme, sourceId, a, b, aText, bText); answer takes distinct (cacheKey, title, audience, x, y) and returns (cacheKey, verdict, rationale, error)."""
    joined = pairs.join(sources, "sourceId", "left").withColumn("title", F.coalesce("title", "sourceId"))
    own = lambda order: [] if share else [F.lit(order), F.col("scheme"), F.col("a"), F.col("b")]
    key = lambda x, y, order: hashed("pairwise", judge_hash, PAIRWISE_VERSION, F.col("title"), F.coalesce("audience", F.lit(DEFAULT_AUDIENCE)), x, y, *own(order))
    joined = joined.withColumns({"keyAB": key(F.col("aText"), F.col("bText"), "AB"), "keyBA": key(F.col("bText"), F.col("aText"), "BA")})
    both = joined.select("title", "audience", F.explode(F.array(F.struct(F.col("keyAB").alias("k"), F.col("aText").alias("x"), F.col("bText").alias("y")), F.struct(F.col("keyBA").alias("k"), F.col("bText").alias("x"), F.col("aText").alias("y")))).alias("r"))
    both = both.select(F.col("r.k").alias("cacheKey"), "title", "audience", F.col("r.x").alias("x"), F.col("r.y").alias("y"))
    answers, new = cached(both, cache if share else None, answer)
    side = lambda s: answers.select(F.col("cacheKey").alias(f"key{s}"), F.col("verdict").alias(f"said{s}"), F.col("rationale").alias(f"why{s}"), F.col("error").alias(f"error{s}"))
    told = joined.join(side("AB"), "keyAB").join(side("BA"), "keyBA").withColumns({"verdictAB": F.col("saidAB"), "verdictBA": flip(F.col("saidBA")), "error": F.coalesce("errorAB", "errorBA")})
    return told.select(
        F.lit("pairwise").alias("kind"), "scheme", "sourceId", F.col("a").alias("aSampleId"), F.col("b").alias("bSampleId"), F.sha2("aText", 256).alias("aTextHash"), F.sha2("bText", 256).alias("bTextHash"),
        context_hash(F.col("title"), F.col("audience")).alias("contextHash"), F.lit(judge_hash).alias("judgeConfigHash"), F.lit(judge_model).alias("judgeModel"), F.lit(PAIRWISE_VERSION).alias("promptVersion"),
        "verdictAB", "verdictBA", combine(F.col("verdictAB"), F.col("verdictBA")).alias("verdict"), F.concat(F.lit("a first: "), F.coalesce("whyAB", F.lit("")), F.lit("\nb first: "), F.coalesce("whyBA", F.lit(""))).alias("rationale"), created().alias("createdAt"), "error",
    ), new


def created() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def verdicts(judgments: DataFrame) -> DataFrame:
    """(scheme, a, b, verdict) of pairwise judgments."""
    return judgments.filter("kind = 'pairwise'").select("scheme", F.col("aSampleId").alias("a"), F.col("bSampleId").alias("b"), "verdict")
