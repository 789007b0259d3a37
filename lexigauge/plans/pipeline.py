"""Making samples: the steps of interventions over sources, level by level.

A level is one table of jobs. Steps are column expressions for the mock provider and Arrow batches for providers that are
called; an error in a job is a value in its row, and later steps pass it by.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import hashed, trim
from ..functions.lint import fix, pack_of, rules_version
from ..functions.text import escape_delimiters, prompt_of, rewrite, strip_markdown, tagged
from ..operators.judge import TAGS
from ..schema import DEFAULT_AUDIENCE, NO_MODEL, PIPELINE_VERSION, STEP
from ..sources.providers import Answer, Provider, provider_for
from ..tables import written
from .planning import Plan, levels, sample_id

JOBS = ["sourceId", "modelId", "interventionId", "sampleIndex"]


def render(template: str, values: dict[str, str]) -> str:
    """{{name}} becomes a value, an unknown one nothing; what is put in is not read again."""
    out, rest = [], template
    while (at := rest.find("{{")) >= 0 and (end := rest.find("}}", at)) >= 0:
        out += [rest[:at], values.get(rest[at + 2 : end].strip(), "")]
        rest = rest[end + 2 :]
    return "".join([*out, rest])


def non_empty(text: Column, message: str) -> Column:
    """An error where a text is blank."""
    return F.when(trim(F.coalesce(text, F.lit(""))) == "", F.lit(message))


def content_error(text: Column) -> Column:
    """What keeps a result from being evaluated: no text, a blank one, or nothing but code."""
    return F.when(text.isNull(), "no text").when(trim(text) == "", "the text is blank").when(trim(strip_markdown(text)) == "", "the text is only code")


def source_hash(sources: DataFrame) -> Column:
    return hashed(F.col("sourceType"), F.coalesce("prompt", "text"), F.coalesce("title", "id"), F.coalesce("audience", F.lit(DEFAULT_AUDIENCE)))


def read_steps(intervention: dict) -> list[dict]:
    """Steps with the content of the files they name, and the lint pack of a fixing step's configuration."""
    out = []
    for s in intervention["steps"]:
        s = dict(s)
        for key in ("system", "prompt"):
            if s.get(key) and (path := Path(intervention.get("dir", "."), s[key])).is_file():
                s[f"{key}Text"] = path.read_text("utf-8")
        if s["type"] == "textlint-fix":
            s["pack"] = pack_of(str(Path(intervention.get("dir", "."), s["config"]))) if s.get("config") else "default"
        out.append(s)
    return out


def model_provenance(model: dict | None, fixtures: dict[str, str]) -> dict | None:
    """A model's configuration; of a mock one, whose texts are fixtures, with a hash of its fixture file."""
    if model is None or model["provider"] != "mock":
        return model
    return model | {"fixtures": hashlib.sha256(fixtures.get(model.get("mockStyle", "plain"), "").encode()).hexdigest()}


def definition_hash(intervention: dict, model: dict | None, models: dict[str, dict], lint_version: str = "", fixtures: dict[str, str] | None = None) -> str:
    """All that a cell's samples depend on but the source, as canonical JSON. fixtures: style -> content of its file; lint_version: the rules of the default pack."""
    at = fixtures or {}
    steps = []
    for s in read_steps(intervention):
        s = {k: v for k, v in s.items() if k != "pack"} | ({"rules": lint_version if s["pack"] == "default" else rules_version(s["pack"])} if "pack" in s else {})
        steps.append(s | ({"modelConfig": model_provenance(models.get(s["model"]), at)} if s.get("model") else {}))
    text = json.dumps([PIPELINE_VERSION, model_provenance(model, at), steps], ensure_ascii=False, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def expected_hashes(sources: DataFrame, interventions: list[dict], models: list[dict], lint_version: str = "", fixtures: dict[str, str] | None = None) -> DataFrame:
    """(sourceId, modelId, interventionId, expectedHash) of every cell that could be."""
    by_id = {m["id"]: m for m in models}
    rows = [(m["id"] if m else NO_MODEL, i["id"], definition_hash(i, m, by_id, lint_version, fixtures)) for i in interventions for m in [None, *models]]
    cells = sources.sparkSession.createDataFrame(rows, "modelId string, interventionId string, definition string")
    # a definition for each model and intervention: the product is the table of cells
    return sources.withColumn("_source", source_hash(sources)).crossJoin(cells).select(F.col("id").alias("sourceId"), "modelId", "interventionId", hashed(F.col("_source"), F.col("definition")).alias("expectedHash"))


#: What a step of a job gives besides its text.
SPENT = "struct<servedBy:string,inputTokens:bigint,outputTokens:bigint,ms:bigint>"


def called(jobs: DataFrame, call: Callable[[Provider, str, str], str | Answer], models: dict[str, dict], parallel: int | None = None) -> DataFrame:
    """jobs with the text that a provider gives for (system, request), in batches; what it raises becomes the row's error. A column `spent` says what it took."""
    schema = jobs.select("*").schema
    spends = "spent" in jobs.columns
    if parallel:
        jobs = jobs.repartition(parallel)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts, errors, spent = [], [], []
            for r in rows.itertuples():
                text, error, began = r.text, r.error, time.monotonic()
                said = None
                if not error:
                    try:
                        said = call(provider_for(models[r.callModel]), r.system, r.request)
                        said = said if isinstance(said, Answer) else Answer(said)
                        text = said.text
                    except Exception as e:  # noqa: BLE001
                        error = str(e) or type(e).__name__
                texts.append(text)
                errors.append(error)
                spent.append({"servedBy": said and said.served_by, "inputTokens": said and said.input_tokens, "outputTokens": said and said.output_tokens, "ms": int((time.monotonic() - began) * 1000)})
            yield rows.assign(text=texts, error=errors, **({"spent": spent} if spends else {}))

    return jobs.mapInPandas(run, schema)


TRACE = f"array<{STEP}>"


def traced(kind: str, **values: Column) -> Column:
    """The rows' trace with one more step."""
    names = [f.split(":", 1)[0] for f in ("type", "skipped", "ms", "modelId", "servedBy", "reusedFrom", "reusedHash", "applied", "remaining", "usage")]
    step = F.struct(*[(F.lit(kind) if n == "type" else values.get(n, F.lit(None))).alias(n) for n in names]).cast(STEP)
    return F.when(F.col("error").isNull(), F.concat("steps", F.array(step))).otherwise(F.col("steps"))


def usage(spent: Column) -> Column:
    """Tokens, null where none are known."""
    return F.when(spent["inputTokens"].isNotNull() | spent["outputTokens"].isNotNull(), F.struct(spent["inputTokens"].alias("inputTokens"), spent["outputTokens"].alias("outputTokens")))


def both_spent(a: Column, b: Column) -> Column:
    """What several passes took together; the last one says who served."""
    add = lambda n: F.when(a[n].isNull() & b[n].isNull(), F.lit(None)).otherwise(F.coalesce(a[n], F.lit(0)) + F.coalesce(b[n], F.lit(0))).alias(n)
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.struct(b["servedBy"].alias("servedBy"), add("inputTokens"), add("outputTokens"), add("ms"))).cast(SPENT)


def run_level(jobs: DataFrame, sources: DataFrame, store: DataFrame, interventions: list[dict], models: list[dict], fixtures: DataFrame | None = None, parallel: int | None = None) -> DataFrame:
    """Samples of one level's jobs. store: samples made so far, for what is taken over; sources: (id, sourceType, title, audience, prompt, text)."""
    by_id = {m["id"]: m for m in models}
    out: list[DataFrame] = []
    info = sources.select(F.col("id").alias("sourceId"), "sourceType", "title", "audience", "prompt", F.col("text").alias("given"))
    for intervention in interventions:
        rows = jobs.filter(F.col("interventionId") == intervention["id"]).select(*JOBS).join(info, "sourceId")
        given = F.when(F.col("sourceType") == "corpus", F.col("given"))
        rows = rows.withColumns({"text": given, "before": given, "error": F.lit(None).cast("string"), "steps": F.array().cast(TRACE)})
        for step in read_steps(intervention):
            rows = apply_step(rows, step, store, by_id, fixtures, parallel)
        error = F.coalesce("error", content_error(F.col("text")))
        out.append(rows.select(sample_id().alias("id"), "sourceType", *JOBS, F.coalesce("text", F.lit("")).alias("text"), F.when(error.isNotNull() | ~F.col("before").eqNullSafe(F.col("text")), F.col("before")).alias("inputText"), "steps", error.alias("error")))
    made = out[0]
    for more in out[1:]:
        made = made.unionByName(more)
    return made


def apply_step(rows: DataFrame, step: dict, store: DataFrame, models: dict[str, dict], fixtures: DataFrame | None, parallel: int | None) -> DataFrame:
    """The rows after a step: their text, what it was before, their error, and one more entry in their trace."""
    going = F.col("error").isNull()
    if step["type"] == "textlint-fix":
        rows = rows.withColumn("_f", F.when(going, fix(F.col("text"), step["pack"])))
        return rows.withColumns({"text": F.coalesce("_f.text", "text"), "steps": traced("textlint-fix", applied=F.col("_f.applied"), remaining=F.col("_f.remaining"))}).drop("_f")
    if step["type"] == "generate" and step.get("reuse"):
        parents = store.filter(F.col("interventionId") == step["reuse"]).select("sourceId", F.col("modelId").alias("pm"), "sampleIndex", F.col("id").alias("pid"), F.col("text").alias("pt"), F.col("error").alias("pe"))
        same = parents.withColumnRenamed("pm", "modelId")
        bare = parents.filter(F.col("pm") == NO_MODEL).select("sourceId", "sampleIndex", F.col("pid").alias("bid"), F.col("pt").alias("bt"), F.col("pe").alias("be"))
        rows = rows.join(same, ["sourceId", "modelId", "sampleIndex"], "left").join(bare, ["sourceId", "sampleIndex"], "left")
        corpus = (F.col("sourceType") == "corpus") & F.col("pid").isNull()
        got = {k: F.when(corpus, F.col(b)).otherwise(F.col(p)) for k, p, b in (("id", "pid", "bid"), ("text", "pt", "bt"), ("error", "pe", "be"))}
        bad = F.when(got["id"].isNull(), F.lit(f"nothing of {step['reuse']} to take over")).when(F.coalesce(got["error"], F.lit("")) != "", F.lit(f"{step['reuse']} failed")).otherwise(non_empty(got["text"], f"{step['reuse']} is empty"))
        rows = rows.withColumn("error", F.coalesce("error", bad))
        rows = rows.withColumn("steps", traced("generate", modelId=F.nullif(F.col("modelId"), F.lit(NO_MODEL)), reusedFrom=got["id"], reusedHash=F.sha2(got["text"], 256)))
        taken = F.col("error").isNull()
        return rows.withColumns({"before": F.when(taken, got["text"]).otherwise(F.col("before")), "text": F.when(taken, got["text"]).otherwise(F.col("text"))}).drop("pid", "pt", "pe", "bid", "bt", "be")
    if step["type"] == "generate":
        request = prompt_of(F.lit(step.get("promptPrefix") or ""), F.coalesce("prompt", F.lit("")), F.lit(step.get("promptSuffix") or ""))
        # a given text is its own first version
        asked = F.col("sourceType") == "task"
        made = answered(rows.withColumns({"request": request, "system": F.lit(step.get("systemText", "")), "callModel": F.col("modelId")}), models, fixtures, parallel, asked)
        made = made.withColumn("error", F.coalesce("error", F.when(asked, non_empty(F.col("text"), "the generated text is empty"))))
        made = made.withColumn("text", F.when(asked & F.col("error").isNull(), trim(F.col("text"))).when(~asked, F.col("text")))
        spent = F.col("spent")
        made = made.withColumn("steps", traced("generate", skipped=F.when(~asked, F.lit(True)), ms=F.coalesce(spent["ms"], F.lit(0)), modelId=F.when(asked, F.col("modelId")), servedBy=F.when(asked, spent["servedBy"]), usage=F.when(asked, usage(spent))))
        return made.withColumn("before", F.coalesce("text", "before")).drop("spent")
    template = step.get("promptText", "{{text}}")
    model = F.lit(step["model"]) if step.get("model") else F.col("modelId")
    tags = [*TAGS, *(t for t in re.findall(r"</([A-Za-z_][A-Za-z0-9_-]*)\s*>", template) if t not in TAGS)]
    rows = rows.withColumn("total", F.lit(None).cast(SPENT))
    for _ in range(step.get("passes", 1)):
        values = {"text": escape_delimiters(F.col("text"), tags), "audience": F.coalesce("audience", F.lit(DEFAULT_AUDIENCE)), "title": F.coalesce("title", "sourceId")}
        rows = rows.withColumns({"held": F.col("text"), "request": rendered(template, values), "system": F.lit(""), "callModel": model})
        rows = answered(rows, models, None, parallel, F.lit(True), rewriting=True)
        rows = rows.withColumn("error", F.coalesce("error", non_empty(F.col("text"), "the rewritten text is empty")))
        rows = rows.withColumn("text", F.when(F.col("error").isNull(), trim(F.col("text"))).otherwise(F.col("held")))
        rows = rows.withColumn("total", both_spent(F.col("total"), F.col("spent"))).drop("spent", "held")
    total = F.col("total")
    return rows.withColumn("steps", traced("rewrite", ms=F.coalesce(total["ms"], F.lit(0)), modelId=model, servedBy=total["servedBy"], usage=usage(total))).drop("total")


def rendered(template: str, values: dict[str, Column]) -> Column:
    """render() with columns: {{name}} becomes a column's value, an unknown one nothing; what is put in is not read again."""
    parts, rest = [], template
    while (at := rest.find("{{")) >= 0 and (end := rest.find("}}", at)) >= 0:
        parts += [F.lit(rest[:at]), F.coalesce(values.get(rest[at + 2 : end].strip(), F.lit("")), F.lit(""))]
        rest = rest[end + 2 :]
    return F.concat(*parts, F.lit(rest))


def answered(rows: DataFrame, models: dict[str, dict], fixtures: DataFrame | None, parallel: int | None, asked: Column, rewriting: bool = False) -> DataFrame:
    """rows with the text of a model and `spent`; mock models are expressions, others are called."""
    mocks = [m for m, c in models.items() if c["provider"] == "mock"]
    mock = F.col("callModel").isin(*mocks) if mocks else F.lit(False)
    unknown = F.when(asked & ~F.coalesce(F.col("callModel").isin(*models), F.lit(False)), F.lit("the step needs a model"))
    rows = rows.withColumn("error", F.coalesce("error", unknown))
    going = F.col("error").isNull() & asked
    style = F.coalesce(*[F.when(F.col("callModel") == m, F.lit(models[m].get("mockStyle", "plain"))) for m in mocks], F.lit("plain"))
    if rewriting:
        rows = rows.withColumn("_body", F.lit(None).cast("string"))
        # the mock model rewrites what the request holds between its text tags, else the request
        text = rewrite(F.coalesce(tagged(F.col("request"), "text"), F.col("request")))
    else:
        rows = rows.withColumn("_style", style)
        if fixtures is not None:
            rows = rows.join(fixtures.select(F.col("style").alias("_style"), F.col("id").alias("sourceId"), F.col("body").alias("_body")), ["_style", "sourceId"], "left")
        else:
            rows = rows.withColumn("_body", F.lit(None).cast("string"))
        text = F.coalesce("_body", fallback(F.col("_style"), F.col("sourceId")))
    served = F.struct(F.concat(F.lit("mock:"), style).alias("servedBy"), F.lit(None).alias("inputTokens"), F.lit(None).alias("outputTokens"), F.lit(0).alias("ms")).cast(SPENT)
    rows = rows.withColumns({"text": F.when(going & mock, text).otherwise(F.col("text")), "spent": F.when(going & mock, served).otherwise(F.lit(None).cast(SPENT))}).drop("_style", "_body")
    real = [m for m in models if m not in mocks]
    if real:
        calls = F.coalesce(going & F.col("callModel").isin(*real), F.lit(False))
        said = called(rows.filter(calls), lambda p, system, request: p.generate(system, request), models, parallel)
        # answers cost money: they are written before anything reads them twice
        rows = rows.filter(~calls).unionByName(written(said).select(*rows.columns))
    return rows.drop("request", "system", "callModel")


def fallback(style: Column, source: Column) -> Column:
    """What the mock model writes about a source without a fixture: two remarks on reading, one terse, one wordy."""
    terse = F.concat(source, F.lit("の見本文です。短い文は目で追いやすい。大事なことを先に書くと、なお良いでしょう。"))
    wordy = F.concat(source, F.lit("という見出しのもとに置かれた見本文というものですが、長い文において修飾を重ねることができるとしても、読み手は、主語を見失い、述語を待ち続け、何度も行を戻ることになるのではないでしょうか。"))
    return F.when(style == "verbose", wordy).otherwise(terse)


def run(plan: Plan, sources: DataFrame, store: DataFrame, interventions: list[dict], models: list[dict], fixtures: DataFrame | None = None, parallel: int | None = None) -> DataFrame:
    """All samples of a plan. A level is written before the next one reads it; samples that failed are not taken over."""
    by_id = {i["id"]: i for i in interventions}
    chosen = [r[0] for r in plan.jobs.select("interventionId").distinct().collect()]  # a name for each intervention
    jobs = written(plan.jobs)
    made: DataFrame | None = None
    known = store.select("id", *JOBS, "text", "error").join(jobs.select("id"), "id", "left_anti")
    for level in levels(chosen, interventions):
        if not level:
            continue
        new = written(run_level(jobs, sources, known, [by_id[i] for i in level], models, fixtures, parallel=parallel))
        made = new if made is None else made.unionByName(new)
        known = known.unionByName(new.filter(F.coalesce("error", F.lit("")) == "").select(*known.columns))
    return made
