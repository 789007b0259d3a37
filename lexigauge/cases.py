"""Queries over small inputs made by hand, or made of the smallest given tables: what the tables cannot show, such as definitions, plans, steps and formats.

The SQL of each says what must come out, in values written by hand or from the tables.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import compat, lint, text, tokens
from .operators import full_report, human, judge, pairs, render, report
from .plans import pipeline, planning
from .registry import cases, folder, query, table
from .schema import RUBRIC_KEYS, SAMPLES, check_id, check_run_id
from .sources import definitions, logs, providers

GENERATE = {"type": "generate"}
BASE = {"id": "baseline", "name": "B", "steps": [GENERATE]}
FIX = {"id": "fix", "name": "F", "steps": [{"type": "generate", "reuse": "baseline"}, {"type": "textlint-fix"}]}
REWRITE = {"id": "rewrite", "name": "R", "steps": [{"type": "generate", "reuse": "fix"}, {"type": "rewrite", "prompt": "{{text}}"}]}
PINNED = {"id": "pinned", "name": "P", "steps": [GENERATE, {"type": "rewrite", "prompt": "{{text}}", "model": "m"}]}
BOTH = {"id": "both", "name": "D", "steps": [{"type": "generate", "reuse": "baseline"}, {"type": "generate", "reuse": "fix"}]}
ALL = [BASE, FIX, REWRITE, PINNED, BOTH]


def facts(name: str, rows: list[tuple[Callable[[], object], str]]) -> None:
    """A query over what functions of the driver say; its SQL is what they must say. An error counts as its kind."""
    values = ", ".join(f"({n}, '{said.replace(chr(39), chr(39) * 2)}')" for n, (_, said) in enumerate(rows))

    @query(name, f"SELECT * FROM (VALUES {values}) v(n, said)")
    def run(spark, sf_dir):
        def told(f: Callable[[], object]) -> str:
            try:
                out = f()
            except (ValueError, RuntimeError) as e:
                return type(e).__name__
            return out if isinstance(out, str) else json.dumps(out, ensure_ascii=False)

        return spark.createDataFrame([(n, told(f)) for n, (f, _) in enumerate(rows)], "n int, said string")


def files(**content: str) -> Path:
    """A folder of the driver with these files; a double underscore in a name stands for a dot."""
    at = Path(tempfile.mkdtemp(prefix="lexigauge-cases-"))
    for name, body in content.items():
        (at / name.replace("__", ".")).write_text(body, "utf-8")
    return at


ids = lambda items: " ".join(i["id"] for i in items)
TASK = "id: {0}\ncategory: c\ntitle: T\nprompt: P\n"

facts(
    "definition_files",
    [
        (lambda: ids(definitions.load_tasks(files(b__yaml=TASK.format("b"), a__yaml=TASK.format("a"), _x__yaml="not read", c__txt="nor this"))), "a b"),
        (lambda: definitions.load_tasks("/no/such/folder"), "[]"),
        (lambda: definitions.load_tasks(files(a__yaml=TASK.format("a") + "resue: b\n")), "DefinitionError"),
        (lambda: definitions.load_tasks(files(a__yaml="id: a\ntitle: T\n")), "DefinitionError"),
        (lambda: definitions.load_tasks(files(a__yaml=TASK.format("x"), b__yaml=TASK.format("x"))), "DefinitionError"),
        (lambda: definitions.load_tasks(files(a__yaml=TASK.format("a__b"))), "ValueError"),
        (lambda: [(c["id"], c["title"], c["text"]) for c in definitions.load_corpus(files(a__md="---\ntitle: X\n---\nbody\n", b__md="plain"))], '[["a", "X", "body"], ["b", "b", "plain"]]'),
        (lambda: definitions.load_corpus(files(a__md="---\ntitle: X\nbody")), "DefinitionError"),
        (lambda: definitions.load_corpus(files(a__md="---\ntitel: X\n---\nbody")), "DefinitionError"),
        (lambda: definitions.load_models(files(m__yaml="models:\n- {id: a, provider: mock, model: x}\njudge: {model: a}\n") / "m.yaml")["judge"]["model"], "a"),
        (lambda: definitions.load_models(files(m__yaml="models:\n- {id: none, provider: mock, model: x}\njudge: {model: a}\n") / "m.yaml"), "ValueError"),
        (lambda: definitions.load_models(files(m__yaml="models:\n- {id: a, provider: other, model: x}\njudge: {model: a}\n") / "m.yaml"), "DefinitionError"),
        (lambda: ids(definitions.load_interventions(files(b__yaml="id: b\nname: B\nsteps:\n- {type: generate}\n", f__yaml="id: f\nname: F\nsteps:\n- {type: generate, reuse: b}\n- {type: textlint-fix}\n"))), "b f"),
        (lambda: definitions.load_interventions(files(b__yaml="id: b\nname: B\nsteps: []\n")), "DefinitionError"),
        (lambda: definitions.load_interventions(files(b__yaml="id: b\nname: B\nsteps:\n- {type: generate, reuse: c}\n")), "DefinitionError"),
        (lambda: definitions.load_interventions(files(b__yaml="id: b\nname: B\nsteps:\n- {type: rewrite, prompt: p.txt}\n", p__txt="no place for a text")), "DefinitionError"),
        (lambda: definitions.load_interventions(files(b__yaml="id: b\nname: B\nsteps:\n- {type: rewrite, prompt: p, model: z}\n"), [{"id": "a"}]), "DefinitionError"),
        (lambda: ids(definitions.load_sources([{"id": "a"}], [{"id": "b"}])), "a b"),
        (lambda: definitions.load_sources([{"id": "a"}], [{"id": "a"}]), "DefinitionError"),
    ],
)
facts(
    "option_values",
    [
        (lambda: ids(definitions.pick([{"id": "a"}, {"id": "b"}], ["b", "a", "b"], "x")), "b a b"),
        (lambda: definitions.pick([{"id": "a"}], ["z"], "x"), "DefinitionError"),
        (lambda: definitions.parse_list(" a,, b "), '["a", "b"]'),
        (lambda: definitions.parse_list(" , "), "DefinitionError"),
        (lambda: definitions.parse_schemes(None), '["interventions", "models"]'),
        (lambda: definitions.parse_schemes("models,models"), '["models"]'),
        (lambda: definitions.parse_schemes("model"), "DefinitionError"),
        (lambda: definitions.parse_count("12"), "12"),
        (lambda: definitions.parse_count("0", 0), "0"),
        (lambda: definitions.parse_count("0"), "DefinitionError"),
        (lambda: definitions.parse_count("1.5"), "DefinitionError"),
        (lambda: definitions.parse_count("3x"), "DefinitionError"),
        (lambda: check_id("style-prompt+textlint_5.1"), "style-prompt+textlint_5.1"),
        (lambda: check_id("a b"), "ValueError"),
        (lambda: check_id("-a"), "ValueError"),
        (lambda: check_run_id("run-1.b"), "run-1.b"),
        (lambda: check_run_id("../x"), "ValueError"),
        (lambda: check_run_id("a/b"), "ValueError"),
        (lambda: logs.run_files("root/", "r")["samples"], "root/r/samples.jsonl"),
        (lambda: report.check_baseline("fix", ALL), "fix"),
        (lambda: report.check_baseline("fxi", ALL), "ValueError"),
        (lambda: logs.parse_dotenv("# c\nexport A='x y'\nB=1 # tail\nC=\"q\"\n\nD = \nE=a=b\n"), '{"A": "x y", "B": "1", "C": "q", "D": "", "E": "a=b"}'),
    ],
)
facts(
    "reuse_graph",
    [
        (lambda: planning.reused(BOTH), '["baseline", "fix"]'),
        (lambda: planning.reused(BASE), "[]"),
        (lambda: sorted(planning.dependents("baseline", ALL)), '["both", "fix", "rewrite"]'),
        (lambda: sorted(planning.dependents("fix", ALL)), '["both", "rewrite"]'),
        (lambda: planning.levels(["both", "rewrite", "fix", "baseline"], ALL), '[["baseline"], ["fix"], ["both", "rewrite"]]'),
        (lambda: planning.levels(["fix"], [FIX]), '[[], ["fix"]]'),
        (lambda: planning.levels(["a"], [{"id": "a", "steps": [{"type": "generate", "reuse": "b"}]}, {"id": "b", "steps": [{"type": "generate", "reuse": "a"}]}]), "ValueError"),
        (lambda: [i["id"] for i in ALL if planning.needs_model(i, ALL)], '["rewrite"]'),
    ],
)
MOCK = {"id": "m", "provider": "mock", "model": "x"}
facts(
    "configuration_hashes",
    [
        (lambda: judge.config_hash(MOCK) == judge.config_hash(MOCK | {"id": "n", "label": "l"}), "true"),
        (lambda: judge.config_hash(MOCK) == judge.config_hash(MOCK | {"model": "y"}), "false"),
        (lambda: pipeline.definition_hash(BASE, MOCK, {}) == pipeline.definition_hash(BASE, dict(MOCK), {}), "true"),
        (lambda: pipeline.definition_hash(BASE, MOCK, {}) == pipeline.definition_hash(BASE, None, {}), "false"),
        (lambda: pipeline.definition_hash(FIX, MOCK, {}, "1") == pipeline.definition_hash(FIX, MOCK, {}, "2"), "false"),
        (lambda: pipeline.definition_hash(BASE, MOCK, {}, "1") == pipeline.definition_hash(BASE, MOCK, {}, "2"), "true"),
        (lambda: pipeline.definition_hash(BASE, MOCK, {}, "", {"plain": "a"}) == pipeline.definition_hash(BASE, MOCK, {}, "", {"plain": "b"}), "false"),
        (lambda: pipeline.definition_hash(PINNED, None, {"m": MOCK}) == pipeline.definition_hash(PINNED, None, {"m": MOCK | {"model": "y"}}), "false"),
        (lambda: lint.rules_version() == lint.rules_version("fixable"), "false"),
        (lambda: lint.packages_of('{"rules": {"preset-a": {}, "b": false, "@s/c": true}, "filters": {"d": true}}'), '["@s/textlint-rule-c", "textlint", "textlint-filter-rule-d", "textlint-rule-preset-a"]'),
    ],
)


class Shouting:
    """A provider of one's own."""

    def __init__(self, config: dict):
        self.mark = config.get("model", "!")

    def generate(self, system: str, prompt: str) -> providers.Answer:
        if prompt == "refuse":
            raise RuntimeError("refused")
        return providers.Answer(prompt.upper() + self.mark, "shouting", len(prompt), 1)


def shouting() -> object:
    providers.register("shouting", Shouting)
    return providers.provider_for({"provider": "shouting", "model": "?"}).generate("", "hey").text


facts(
    "provider_registry",
    [
        (shouting, "HEY?"),
        (lambda: type(providers.provider_for(MOCK)).__name__, "MockProvider"),
        (lambda: providers.provider_for(MOCK) is providers.provider_for(dict(MOCK)), "true"),
        (lambda: str(providers.provider_for({"provider": "nobody"})), "ValueError"),
        (lambda: str(providers.provider_for({"provider": "openai", "baseUrl": "x", "model": "y", "apiKeyEnv": "LEXIGAUGE_NO_SUCH_KEY"})), "RuntimeError"),
        (lambda: sorted(judge.RUBRIC_SCHEMA["properties"]), '["clarity", "concision", "naturalness", "overall", "rationale", "readability", "structure"]'),
        (lambda: judge.checked({"verdict": "tie", "rationale": "r"}, judge.PAIRWISE_SCHEMA)["verdict"], "tie"),
        (lambda: judge.checked({"verdict": "C", "rationale": "r"}, judge.PAIRWISE_SCHEMA), "ValueError"),
        (lambda: judge.checked(dict.fromkeys(RUBRIC_KEYS, 6) | {"rationale": "r"}, judge.RUBRIC_SCHEMA), "ValueError"),
        (lambda: judge.checked(dict.fromkeys(RUBRIC_KEYS, 5), judge.RUBRIC_SCHEMA), "ValueError"),
    ],
)
facts(
    "report_formats",
    [
        (lambda: render.fixed(2.5, 0), "3"),
        (lambda: render.fixed(-2.5, 0), "-3"),
        (lambda: render.fixed(1.005, 2), "1.00"),
        (lambda: render.number("kanjiRatio", 0.1234), "12.3%"),
        (lambda: render.number("chars", 3.14159), "3.14"),
        (lambda: render.number("chars", None), "–"),
        (lambda: render.stat("chars", 2.0, 3, 4), "2.00 [n=3]"),
        (lambda: render.stat("chars", 2.0, 4, 4), "2.00"),
        (lambda: render.percent(12.34), "+12.3%"),
        (lambda: render.percent(-5.0, 1.0, 2, 3), "-5.0% (対 2 件)"),
        (lambda: render.percent(None, 2.0), "(+2.00, 基準 0)"),
        (lambda: render.percent(None), "–"),
        (lambda: render.wins({"rate": 0.75, "wins": 1, "losses": 0, "ties": 1, "n": 2}), "75.0% (1-0-1)"),
        (lambda: render.wins(None), "–"),
        (lambda: render.grid(["a"], [["x|y"]]), "| a |\n| --- |\n| x\\|y |"),
    ],
)

# texts

cases("tag_cases", [("<x>\nin\n</x>", "in"), ("<x></x>", ""), ("a <x>one</x><x>two</x>", "one"), ("<x>open", "none"), ("<y>other</y>", "none")], lambda t: F.coalesce(text.tagged(t, "x"), F.lit("none")))
cases("template_tag_cases", [("</a>{{text}}</a-b >", "text a a-b"), ("no tags <b>", "text"), ("</text></Text>", "text Text")], lambda t: F.array_join(text.delimiter_tags(t, ["text"]), " "))
cases("guard_cases", [("text", ""), ("", "the text is blank"), (" \n　", "the text is blank"), ("```\ncode\n```", "the text is only code"), ("# head", "")], lambda t: F.coalesce(pipeline.content_error(t), F.lit("")))
cases("blank_cases", [("x", ""), ("  ", "nothing"), ("\n", "nothing")], lambda t: F.coalesce(pipeline.non_empty(t, "nothing"), F.lit("")))
cases("fix_cases", [("調査を行う。", "調査する。|1|0"), ("短い。", "短い。|0|0"), ("# 調査を行う", "# 調査を行う|0|1"), ("東京都立中央図書館において読む。", "東京都立中央図書館で読む。|1|1")], lambda t: F.concat_ws("|", *[lint.fix(t)[k] for k in ("text", "applied", "remaining")]))
cases("script_token_cases", [("東京は雨です。", "東京|は|雨|です|。"), ("データABC12を", "データ|ABC12|を"), ("", "")], lambda t: F.array_join(F.transform(tokens.scripts(t), lambda x: x["surface_form"]), "|"))
cases("space_cases", [("　a b　", "ab"), ("\t\n", ""), ("a b﻿", "ab")], compat.squeeze)
cases("fallback_cases", [("a", "aの見本文です。短い文は目で追いやすい。大事なことを先に書くと、なお良いでしょう。")], lambda t: pipeline.fallback(F.lit("plain"), t))


@query("context_hashes", "SELECT r_name AS title, sha256('context' || chr(31) || r_name || chr(31) || CASE WHEN r_regionkey % 2 = 0 THEN '一般的な読者' ELSE '新人' END) AS hash FROM region")
def context_hashes(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("title"), judge.context_hash(F.col("r_name"), F.when(F.col("r_regionkey") % 2 == 1, "新人")).alias("hash"))


@query("template_render", "SELECT n_nationkey, 'To ' || n_name || ':' || chr(10) || '<text>' || chr(10) || '&lt;/text&gt;{{audience}}' || chr(10) || '</text>' AS made FROM nation")
def template_render(spark, sf_dir):
    values = {"audience": F.col("n_name"), "text": text.escape_delimiters(F.lit("</text>{{audience}}"), judge.TAGS)}
    return table(spark, sf_dir, "nation").select("n_nationkey", pipeline.rendered("To {{ audience }}:\n<text>\n{{text}}\n</text>{{none}}", values).alias("made"))


ASKED = "'Rate how easy the text in <text> is to read for 新人. The task was: t. Give readability, clarity, naturalness, concision, structure and overall from 1 to 5, with a reason.' || chr(10) || '<text>' || chr(10) || text || ' &lt;/TEXT &gt;' || chr(10) || '</text>'"


@query("judge_prompts", f"SELECT item_id, {ASKED} AS rubric, 'Say which of the two texts is easier to read for 一般的な読者: A, B or tie, with a reason. The task was: t.' || chr(10) || '<text_a>' || chr(10) || text || chr(10) || '</text_a>' || chr(10) || '<text_b>' || chr(10) || '&lt;text_b&gt;' || chr(10) || '</text_b>' AS pairwise FROM benchmark")
def judge_prompts(spark, sf_dir):
    one = judge.rubric_prompt(F.lit("t"), F.lit("新人"), F.concat("text", F.lit(" </TEXT >")))
    return table(spark, sf_dir, "benchmark").select("item_id", one.alias("rubric"), judge.pairwise_prompt(F.lit("t"), F.lit(None).cast("string"), F.col("text"), F.lit("<text_b>")).alias("pairwise"))


@query(
    "judge_rows",
    """SELECT 'rubric' AS kind, 's' || n_nationkey AS sampleId, sha256(n_name || 'です。') AS textHash, sha256('context' || chr(31) || 'title' || chr(31) || '一般的な読者') AS contextHash, 'cfg' AS judgeConfigHash, 'j' AS judgeModel, 'rubric-v2' AS promptVersion, 5 AS overall, 4 AS structure FROM nation""",
)
def judge_rows(spark, sf_dir):
    """The mock judge of short sentences: all is well, structure a point less."""
    samples = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("sampleId"), F.lit("src").alias("sourceId"), F.concat("n_name", F.lit("です。")).alias("text"))
    sources = spark.createDataFrame([("src", "title", None)], "sourceId string, title string, audience string")
    made, _ = judge.judge_rubric(samples, sources, "j", "cfg", judge.rubric_answers(MOCK))
    return made.select("kind", "sampleId", "textHash", "contextHash", "judgeConfigHash", "judgeModel", "promptVersion", "scores.overall", "scores.structure")


@query("judge_cache", "SELECT 25 AS judged, 20 AS asked")
def judge_cache(spark, sf_dir):
    """Of 25 texts five have an answer from before."""
    samples = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), "n_nationkey").alias("sampleId"), F.lit("src").alias("sourceId"), F.col("n_name").alias("text"), "n_nationkey")
    sources = spark.createDataFrame([("src", "title", None)], "sourceId string, title string, audience string")
    answers = judge.rubric_answers(MOCK)
    _, before = judge.judge_rubric(samples.filter("n_nationkey < 5").drop("n_nationkey"), sources, "j", "cfg", answers)
    made, new = judge.judge_rubric(samples.drop("n_nationkey"), sources, "j", "cfg", answers, before.drop("error"))
    return made.agg(F.count("*").cast("int").alias("judged")).join(new.agg(F.count("*").cast("int").alias("asked")))


SHARES = """WITH t(id, kango, wago, verbs, particles, types, rareru, n) AS (VALUES (1, 2, 3, 2, 1, 5, 1, 5), (2, 1, 2, 1, 0, 7, 0, 7))
SELECT CAST(id AS INTEGER) AS sampleId, n / CASE id WHEN 1 THEN 2.0 ELSE 1.0 END AS tokensPerSentence, types / n AS typeTokenRatio, kango / n AS kangoRatio, wago / n AS wagoRatio, verbs / n AS verbRatio, particles / n AS particleRatio, rareru / CASE id WHEN 1 THEN 2.0 ELSE 1.0 END AS rareruPerSentence FROM t"""


@query("token_shares", SHARES)
def token_shares(spark, sf_dir):
    """Counted by hand from the token rows of registry.TOKENS."""
    from .registry import token_table

    sentences = spark.createDataFrame([(1, 2, 20.0), (2, 1, 20.0)], "sampleId int, sentences int, meanSentenceLength double")
    return tokens.token_metrics(token_table(spark), sentences).select("sampleId", "tokensPerSentence", "typeTokenRatio", "kangoRatio", "wagoRatio", "verbRatio", "particleRatio", "rareruPerSentence")


# runs


def run_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as given texts, and one task, through a text as it is, its mended version and that rewritten."""
    given = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("corpus").alias("sourceType"), F.col("r_name").alias("title"), F.lit(None).cast("string").alias("audience"), F.lit(None).cast("string").alias("prompt"), F.concat("r_name", F.lit("を行う。読みますが、長い。")).alias("text"))
    sources = given.union(spark.createDataFrame([("t", "task", "T", None, "P", None)], given.schema))
    none = spark.createDataFrame([], SAMPLES)
    plan = planning.plan_jobs(sources.select(F.col("id").alias("sourceId"), "sourceType"), [BASE, FIX, REWRITE], ["m"], ALL, none.select("id"), none.select("id"))
    fixtures = spark.createDataFrame([("plain", "t", "  題を行う。 ")], "style string, id string, body string")
    return pipeline.run(plan, sources, none, [BASE, FIX, REWRITE], [MOCK], fixtures)


@query(
    "run_samples",
    """WITH x AS (SELECT 'r' || r_regionkey AS s, r_name || 'を行う。読みますが、長い。' AS a, r_name || 'する。読みますが、長い。' AS b, r_name || 'する。読みます。長い。' AS c FROM region)
    SELECT s || '__none__baseline__0' AS id, a AS text, NULL AS inputText, 'generate skipped' AS steps FROM x UNION ALL SELECT s || '__none__fix__0', b, a, 'generate < ' || s || '__none__baseline__0, textlint-fix 1' FROM x
    UNION ALL SELECT s || '__m__rewrite__0', c, b, 'generate < ' || s || '__none__fix__0, rewrite mock:plain' FROM x
    UNION ALL SELECT * FROM (VALUES ('t__m__baseline__0', '題を行う。', NULL, 'generate mock:plain'), ('t__m__fix__0', '題する。', '題を行う。', 'generate < t__m__baseline__0, textlint-fix 1'), ('t__m__rewrite__0', '題する。', NULL, 'generate < t__m__fix__0, rewrite mock:plain'))""",
)
def run_samples(spark, sf_dir):
    step = lambda s: F.concat_ws(" ", s["type"], F.when(s["skipped"], "skipped"), F.when(s["reusedFrom"].isNotNull(), F.concat(F.lit("< "), s["reusedFrom"])), s["servedBy"], s["applied"].cast("string"))
    return run_of(spark, sf_dir).select("id", "text", "inputText", F.array_join(F.transform("steps", step), ", ").alias("steps"))


def given_spent(n: str) -> Column:
    number = lambda c: F.when(F.col("event_id") % 5 != 0, F.col(c)).cast("bigint")
    return F.when(F.col("event_id") % 3 != 0, F.struct(F.lit(n).alias("servedBy"), number("event_id").alias("inputTokens"), F.when(F.col("event_id") % 7 != 0, F.col("user_id")).cast("bigint").alias("outputTokens"), F.lit(1).cast("bigint").alias("ms"))).cast(pipeline.SPENT)


@query("usage_sums", "SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 5 <> 0 THEN 2 * event_id ELSE -1 END AS inputTokens, CASE WHEN event_id % 3 <> 0 AND event_id % 7 <> 0 THEN user_id ELSE -1 END AS outputTokens FROM events")
def usage_sums(spark, sf_dir):
    """What two passes took together, where tokens are known of one, of both or of none (-1 here)."""
    one = given_spent("a")
    other = F.struct(F.lit("b").alias("servedBy"), one["inputTokens"].alias("inputTokens"), F.lit(None).cast("bigint").alias("outputTokens"), F.lit(2).cast("bigint").alias("ms")).cast(pipeline.SPENT)
    rows = table(spark, sf_dir, "events").select("event_id", pipeline.both_spent(one, other).alias("u"))
    return rows.select("event_id", *[F.coalesce(f"u.{n}", F.lit(-1)).alias(n) for n in ("inputTokens", "outputTokens")])


@query("markdown_sink", "SELECT r_regionkey AS n, '- ' || r_name || ' 読者' AS line FROM region")
def markdown_sink(spark, sf_dir):
    path = folder(spark, "report")
    rows = [r["r_name"] for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    logs.write_text(spark, path, "\n".join(f"- {r} 読者" for r in rows))
    lines = F.posexplode(F.split("value", "\n"))
    return spark.read.text(path, wholetext=True).select(lines.alias("n", "line"))


@query("fixture_files", "SELECT 'plain' AS style, 'r' || r_regionkey AS id, r_name AS body FROM region UNION ALL SELECT 'verbose', 'r' || r_regionkey, r_name || ' ' || r_name FROM region")
def fixture_files(spark, sf_dir):
    """Two files of sections, the first of which has a section twice."""
    path = folder(spark, "fixtures")
    rows = [(r["r_regionkey"], r["r_name"]) for r in table(spark, sf_dir, "region").collect()]
    logs.write_text(spark, f"{path}/plain.md", "=== r0 ===\nbefore\n" + "".join(f"=== r{k} ===\n\n{n}\n\n" for k, n in rows))
    logs.write_text(spark, f"{path}/verbose.md", "".join(f"=== r{k} ===\r\n{n} {n}\r\n" for k, n in rows))
    return logs.read_fixtures(spark, path)


@query(
    "seeded_permutation",
    """WITH RECURSIVE s AS (SELECT k, 42 AS seed FROM range(24) r(k)),
    a AS (SELECT k, CAST((CAST(seed AS HUGEINT) + (k + 1) * CAST(1831565813 AS HUGEINT)) % 4294967296 AS BIGINT) AS t FROM s),
    b AS (SELECT k, t, CAST(CAST(xor(t, t >> 15) AS HUGEINT) * CAST(t | 1 AS HUGEINT) % 4294967296 AS BIGINT) AS u FROM a),
    c AS (SELECT k, xor(u, CAST((CAST(u AS HUGEINT) + CAST(xor(u, u >> 7) AS HUGEINT) * CAST(u | 61 AS HUGEINT) % 4294967296) % 4294967296 AS BIGINT)) AS x FROM b),
    d AS (SELECT 24 - k AS i, CAST(floor(CAST(xor(x, x >> 14) AS DOUBLE) / 4294967296.0 * (25 - k)) AS BIGINT) AS j FROM c),
    p AS (SELECT 25 AS i, range(25) AS l UNION ALL
      SELECT d.i, list_transform(range(25), lambda q: CASE q WHEN d.i THEN p.l[d.j + 1] WHEN d.j THEN p.l[d.i + 1] ELSE p.l[q + 1] END) FROM p JOIN d ON d.i = p.i - 1)
    SELECT CAST(place AS INTEGER) AS place, CAST(l[place + 1] AS INTEGER) AS was FROM p, range(25) r(place) WHERE i = 1""",
)
def seeded_permutation(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(compat.permutation(25, 42))), "place int, was int")


@query("pair_order", "SELECT CAST(n AS INTEGER) AS n, a FROM (VALUES (0), (1), (2), (3), (4)) v(n) CROSS JOIN (SELECT 5 AS a)")
def pair_order(spark, sf_dir):
    """The first five of a nation's pairs in their seeded order: places follow one another, ids are all different."""
    rows = table(spark, sf_dir, "nation").crossJoin(spark.createDataFrame([("m1",), ("m2",)], "modelId string"))
    samples = rows.select(F.concat_ws("-", "n_name", "modelId").alias("id"), F.col("n_name").alias("sourceId"), "modelId", F.lit("baseline").alias("interventionId"), F.lit(0).alias("sampleIndex"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("error"))
    made = pairs.human_pairs(samples, spark.createDataFrame([], "id string, title string, audience string"), ["models"], 42, 5)
    return made.select(F.col("_ord").cast("int").alias("n"), F.lit(0).alias("z"), "id").join(made.agg(F.count_distinct("id").cast("int").alias("a"))).select("n", "a")


@query("pair_currency", "SELECT 'p' || n_nationkey AS id FROM nation WHERE n_nationkey % 5 = 0")
def pair_currency(spark, sf_dir):
    """Of a nation's pairs one in five is as shown; of the others a text, a failure, a title or an audience has changed, in turn."""
    k = F.col("n_nationkey") % 5
    nations = table(spark, sf_dir, "nation")
    shown = nations.select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.col("n_name").alias("sourceId"), F.lit("models").alias("scheme"), F.concat(F.lit("a"), "n_nationkey").alias("aSampleId"), F.concat(F.lit("b"), "n_nationkey").alias("bSampleId"), F.lit("x").alias("aText"), F.lit("y").alias("bText"), F.lit("title").alias("taskTitle"), F.lit(None).cast("string").alias("audience"))
    side = lambda s, t: nations.select(F.concat(F.lit(s), "n_nationkey").alias("id"), F.when((k == 1) & (F.lit(s) == "a"), "changed").otherwise(t).alias("text"), F.when((k == 2) & (F.lit(s) == "b"), "failed").alias("error"))
    sources = nations.select(F.col("n_name").alias("id"), F.when(k == 3, "new").otherwise("title").alias("title"), F.when(k == 4, "新人").alias("audience"))
    return pairs.current_pairs(shown, side("a", "x").union(side("b", "y")), sources).select("id")


@query("votes_on_pairs", "SELECT count(*) AS votes FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def votes_on_pairs(spark, sf_dir):
    """Events are votes on their user's pair; the pairs of users with a purchase are current."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("p"), "user_id").alias("pairId"), "event_type")
    return human.on_pairs(events, events.filter("event_type = 'purchase'").select(F.col("pairId").alias("id")).distinct()).agg(F.count("*").alias("votes"))


@query("baseline_fallback", "SELECT 'r' || r_regionkey AS a, CASE WHEN r_regionkey % 2 = 0 THEN 'own' ELSE 'bare' END || r_regionkey AS b FROM region")
def baseline_fallback(spark, sf_dir):
    """The baseline of the same model where there is one, else the one without a model."""
    regions = table(spark, sf_dir, "region")
    row = lambda i, m, v: [F.concat(F.lit(i), "r_regionkey").alias("id"), F.col("r_name").alias("sourceId"), F.lit(m).alias("modelId"), F.lit(v).alias("interventionId"), F.lit(0).alias("sampleIndex"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("error")]
    samples = regions.select(*row("r", "m", "fix")).union(regions.select(*row("bare", "none", "baseline"))).union(regions.filter("r_regionkey % 2 = 0").select(*row("own", "m", "baseline")))
    return pairs.intervention_pairs(samples).select("a", "b")


@query(
    "whole_report",
    """SELECT name, CAST(value AS DOUBLE) AS value FROM (VALUES ('fix textlintPer1k', 35.7), ('m1 fix textlintPer1k', 50.0), ('m1 fix meanSentenceLength', 25.0), ('m1 fix judgeOverall', 100.0), ('fix judge rate', 0.75), ('m1 fix human rate', 1.0), ('m1 judge rate', 0.0), ('m2 judge rate', 1.0),
    ('agreement', 1.0), ('votes', 3.0), ('rule x/a baseline', 2.0), ('rule x/a fix', 1.0)) v(name, value)""",
)
def whole_report(spark, sf_dir):
    """Four samples, as counted by hand: lint of 10 and 5, 4 and 4; the mean over matched pairs goes from 7 to 4.5."""
    cells = [("b1", "m1", "baseline", 10.0, 80.0, 2), ("f1", "m1", "fix", 5.0, 60.0, 1), ("b2", "m2", "baseline", 4.0, 40.0, 0), ("f2", "m2", "fix", 4.0, 40.0, 0)]
    samples = spark.createDataFrame([(i, "s", m, v, 0, "text", None) for i, m, v, *_ in cells], "id string, sourceId string, modelId string, interventionId string, sampleIndex int, text string, error string")
    scores = spark.createDataFrame([(i, m, v, {"textlintPer1k": a, "meanSentenceLength": b}, {"x/a": n} if n else {}) for i, m, v, a, b, n in cells], "sampleId string, modelId string, interventionId string, metrics map<string,double>, textlintRules map<string,bigint>")
    rubric = [("rubric", i, None, None, None, None, "j", tuple([n] * 6)) for i, n in (("b1", 2), ("f1", 4))]
    pairwise = [("pairwise", None, s, a, b, v, "j", None) for s, a, b, v in (("interventions", "f1", "b1", "A"), ("interventions", "f2", "b2", "tie"), ("models", "b1", "b2", "B"))]
    judgments = spark.createDataFrame(rubric + pairwise, f"kind string, sampleId string, scheme string, aSampleId string, bSampleId string, verdict string, judgeModel string, scores struct<{','.join(k + ':int' for k in RUBRIC_KEYS)}>")
    shown = spark.createDataFrame([("p", "interventions", "f1", "b1")], "id string, scheme string, aSampleId string, bSampleId string")
    votes = spark.createDataFrame([("p", "A", "r1", 10.0), ("p", "A", "r2", 20.0), ("p", "B", "r3", None), ("stale", "B", "r3", 1.0)], "pairId string, choice string, raterId string, seconds double")
    out = full_report.build(samples, scores, judgments, votes, shown)
    cell = {(c["modelId"], c["interventionId"]): c for c in out["cells"]}["m1", "fix"]
    every = {i["interventionId"]: i for i in out["interventions"]}["fix"]
    models = {m["modelId"]: m["judge"]["rate"] for m in out["models"]}
    rows = [("fix textlintPer1k", every["changes"]["textlintPer1k"]["pct"]), *((f"m1 fix {k}", cell["changes"][k]["pct"]) for k in ("textlintPer1k", "meanSentenceLength", "judgeOverall")), ("fix judge rate", every["judge"]["rate"]), ("m1 fix human rate", cell["human"]["rate"])]
    rows += [(f"{m} judge rate", models[m]) for m in ("m1", "m2")] + [("agreement", out["agreement"]["rate"]), ("votes", float(out["counts"]["humanVotes"])), *((f"rule x/a {i}", float(n)) for i, n in out["ruleCounts"]["x/a"].items())]
    return spark.createDataFrame(rows, "name string, value double")


@query("level_barrier", "SELECT 'r' || r_regionkey || '__m__rewrite__0' AS id, 'fix failed' AS error FROM region UNION ALL SELECT 'r' || r_regionkey || '__none__fix__0', 'baseline failed' FROM region UNION ALL SELECT 'r' || r_regionkey || '__none__baseline__0', 'the text is only code' FROM region")
def level_barrier(spark, sf_dir):
    """What failed on one level is not taken over on the next; the error says from where."""
    sources = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("corpus").alias("sourceType"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("audience"), F.lit(None).cast("string").alias("prompt"), F.lit("```\nx\n```").alias("text"))
    none = spark.createDataFrame([], SAMPLES)
    plan = planning.plan_jobs(sources.select(F.col("id").alias("sourceId"), "sourceType"), [BASE, FIX, REWRITE], ["m"], ALL, none.select("id"), none.select("id"))
    made = pipeline.run(plan, sources, none, [BASE, FIX, REWRITE], [MOCK])
    return made.select("id", F.regexp_replace("error", "^nothing of (.*) to take over$", "$1 failed").alias("error"))


@query("locale_order", "SELECT * FROM (VALUES ('alpha', 0), ('Alpha', 1), ('beta', 2), ('Beta', 3), ('éclair', 4), ('zebra', 5)) v(name, place)")
def locale_order(spark, sf_dir):
    """Names as reports list them: letters before case, accents with their letters; not the order of their bytes."""
    return spark.createDataFrame(list(report.ranks(spark, ["zebra", "Beta", "alpha", "éclair", "beta", "Alpha"]).items()), "name string, place int")


@query("timestamp_format", "SELECT r_regionkey, true AS fits FROM region")
def timestamp_format(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.regexp_like(judge.created(), F.lit(r"^2\d{3}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$")).alias("fits"))


def said_aloud(_: providers.Provider, system: str, request: str) -> providers.Answer:
    return Shouting({"model": "!"}).generate(system, request)


@query(
    "provider_calls",
    """SELECT n_name, CASE WHEN n_nationkey % 5 = 0 THEN 'given' WHEN n_nationkey % 5 = 1 THEN 'given' ELSE upper(n_name) || '!' END AS text, CASE WHEN n_nationkey % 5 = 0 THEN 'before' WHEN n_nationkey % 5 = 1 THEN 'refused' END AS error,
    CASE WHEN n_nationkey % 5 > 1 THEN length(n_name) ELSE -1 END AS inputTokens FROM nation""",
)
def provider_calls(spark, sf_dir):
    """Rows that failed before are not asked about; what a provider raises is the row's error; at most three calls run at once."""
    k = F.col("n_nationkey") % 5
    jobs = table(spark, sf_dir, "nation").select("n_name", F.lit("given").alias("text"), F.when(k == 0, "before").alias("error"), F.lit("").alias("system"), F.when(k == 1, "refuse").otherwise(F.col("n_name")).alias("request"), F.lit("m").alias("callModel"), F.lit(None).cast(pipeline.SPENT).alias("spent"))
    made = pipeline.called(jobs, said_aloud, {"m": MOCK}, 3)
    if made.rdd.getNumPartitions() > 3:
        raise RuntimeError("more calls at once than asked for")
    return made.select("n_name", "text", "error", F.coalesce("spent.inputTokens", F.lit(-1)).alias("inputTokens"))
