"""Queries over the given tables, each with DuckDB SQL for the same rows where SQL can express it.

The tables have no evaluation runs, so views of `events` and `documents` stand in: an event is a sample of a user, a
model and an intervention, with its value in hundredths and its property k as metrics; votes and logs are read off the
same rows. Japanese and Markdown come as literals, the same in both engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import compat, lint, text, tokens
from .operators import human, judge, pairs, report, store
from .plans import pipeline, planning
from .session import spread
from .sources import logs
from .tables import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- views of the given tables


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id", F.col("event_id") % 3, "event_type").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("e"), "event_id").alias("id"),
        F.concat(F.lit("s"), "user_id").alias("sourceId"),
        F.concat(F.lit("m"), F.col("event_id") % 3).alias("modelId"),
        F.when(F.col("event_type") == "view", "baseline").otherwise(F.col("event_type")).alias("interventionId"),
        (nth - 1).alias("sampleIndex"),
        F.when(F.col("event_id") % 17 == 0, "failed").alias("error"),
        F.col("props").alias("text"),
        F.floor(F.col("value") * 100 + 0.5).cast("double").alias("cents"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        "event_id", "user_id", "ts",
    )


SAMPLES = """ev AS (SELECT 'e' || event_id AS id, 's' || user_id AS sourceId, 'm' || (event_id % 3) AS modelId,
 CASE event_type WHEN 'view' THEN 'baseline' ELSE event_type END AS interventionId,
 row_number() OVER (PARTITION BY user_id, event_id % 3, event_type ORDER BY ts, event_id) - 1 AS sampleIndex,
 CASE WHEN event_id % 17 = 0 THEN 'failed' END AS error, props AS text, floor(value * 100 + 0.5) AS cents,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_id, user_id, ts FROM events)"""


def metrics(ev: DataFrame) -> DataFrame:
    scores = ev.select(F.col("id").alias("sampleId"), F.create_map(F.lit("textlintPer1k"), F.col("cents"), F.lit("jreadability"), F.col("k")).alias("metrics"))
    return report.metric_rows(scores)


ROWS = "mr AS (SELECT id AS sampleId, 'textlintPer1k' AS key, cents AS value FROM ev WHERE cents IS NOT NULL UNION ALL SELECT id, 'jreadability', k FROM ev WHERE k IS NOT NULL)"
PAIRED = """pr AS (SELECT n.id, n.sourceId, n.sampleIndex, n.modelId, n.interventionId, b.id AS baseId FROM ev n JOIN ev b
 ON n.sourceId = b.sourceId AND n.modelId = b.modelId AND n.sampleIndex = b.sampleIndex
 WHERE n.error IS NULL AND b.error IS NULL AND n.interventionId <> 'baseline' AND b.interventionId = 'baseline')"""
R4 = "floor({} * 10000.0 + 0.5) / 10000.0"
STATS = f"{R4.format('avg(value)')} AS mean, {R4.format('coalesce(stddev_samp(value), 0.0)')} AS sd, count(*) AS n"
CELLS = "cr AS (SELECT mr.*, ev.modelId, ev.interventionId FROM mr JOIN ev ON ev.id = mr.sampleId WHERE ev.error IS NULL)"
RATE = "wins + losses + ties AS n, floor((wins + ties * 0.5) / (wins + losses + ties) * 1000.0 + 0.5) / 1000.0 AS rate"
WIN = "count(*) FILTER (verdict = 'A') AS wins, count(*) FILTER (verdict = 'B') AS losses, count(*) FILTER (verdict = 'tie') AS ties"


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), "user_id").alias("pairId"), F.concat(F.lit("r"), F.col("event_id") % 7).alias("raterId"), F.expr("CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END").alias("choice"),
        (F.col("event_id") % 2 == 0).alias("leftWasA"), F.floor(F.col("value") * 100 + 0.5).cast("double").alias("seconds"), F.col("event_id").alias("_seq"), "user_id",
    )


VOTES = """vo AS (SELECT 'p' || user_id AS pairId, 'r' || (event_id % 7) AS raterId, CASE event_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'tie' END AS choice,
 event_id % 2 = 0 AS leftWasA, floor(value * 100 + 0.5) AS seconds, event_id AS seq, user_id FROM events)"""
TALLY = """ta AS (SELECT pairId, count(*) AS votes, count(*) FILTER (choice = 'A') AS a, count(*) FILTER (choice = 'B') AS b, count(*) FILTER (choice = 'tie') AS tie FROM vo GROUP BY pairId),
 tv AS (SELECT *, CASE WHEN a > b AND a > tie THEN 'A' WHEN b > a AND b > tie THEN 'B' ELSE 'tie' END AS verdict FROM ta)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a key (user, kind of event); the last by time counts."""
    order = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.concat_ws("-", "user_id", "event_type").alias("sampleId"), "props", F.floor(F.col("value") * 100 + 0.5).cast("long").alias("cents"), "event_id", "user_id", order.alias("_seq"))


# --- reports


@query("cell_stats", f"WITH {SAMPLES}, {ROWS}, {CELLS} SELECT modelId, interventionId, key, {STATS} FROM cr GROUP BY ALL")
def cell_stats(spark, sf_dir):
    ev = samples(spark, sf_dir)
    return report.cell_statistics(metrics(ev), ev)


@query("cell_counts", f"WITH {SAMPLES} SELECT modelId, interventionId, count(*) AS samples, count(error) AS errors FROM ev GROUP BY ALL")
def cell_counts(spark, sf_dir):
    return report.cell_counts(samples(spark, sf_dir))


@query("intervention_rollup", f"WITH {SAMPLES}, {ROWS}, {CELLS} SELECT coalesce(modelId, '*') AS modelId, interventionId, key, {STATS} FROM cr GROUP BY GROUPING SETS ((modelId, interventionId, key), (interventionId, key))")
def intervention_rollup(spark, sf_dir):
    ev = samples(spark, sf_dir)
    return report.rollup_statistics(metrics(ev), ev)


@query("model_table", f"WITH {SAMPLES} SELECT modelId, count(*) AS samples, count(error) AS errors FROM ev WHERE interventionId = 'baseline' GROUP BY modelId")
def model_table(spark, sf_dir):
    return report.model_table(samples(spark, sf_dir))


IMPROVED = "CASE WHEN b = 0 THEN CASE WHEN n = 0 THEN 0.0 END ELSE floor(CASE WHEN key IN ('textlintPer1k') THEN b - n ELSE n - b END / abs(b) * 100.0 * 10.0 + 0.5) / 10.0 END"


@query(
    "matched_comparison",
    f"""WITH {SAMPLES}, {ROWS}, {PAIRED}, m AS (SELECT pr.modelId, pr.interventionId, x.key, avg(x.value) AS n, avg(y.value) AS b, count(*) AS matchedN
    FROM pr JOIN mr x ON x.sampleId = pr.id JOIN mr y ON y.sampleId = pr.baseId AND y.key = x.key GROUP BY ALL), c AS (SELECT modelId, interventionId, count(*) AS matched FROM pr GROUP BY ALL)
    SELECT m.modelId, m.interventionId, key, {R4.format('(n - b)')} AS delta, {IMPROVED} AS improvementPct, matchedN, matched FROM m JOIN c ON m.modelId = c.modelId AND m.interventionId = c.interventionId""",
)
def matched_comparison(spark, sf_dir):
    ev = samples(spark, sf_dir)
    return report.matched_comparison(metrics(ev), ev)


CASES = [("textlintPer1k", 10.0, 5.0), ("textlintPer1k", 10.0, 15.0), ("jreadability", 2.0, 3.0), ("textlintPer1k", 0.0, 0.0), ("textlintPer1k", 0.0, 2.0), ("chars", 4.0, 5.0), ("kanjiRatio", 0.3, 0.2)]


@query(
    "improvement_cases",
    f"""SELECT key, b AS base, n AS next, CASE WHEN b = 0 THEN CASE WHEN n = 0 THEN 0.0 END ELSE floor(CASE WHEN key IN ('textlintPer1k', 'kanjiRatio') THEN b - n ELSE n - b END / abs(b) * 100.0 * 10.0 + 0.5) / 10.0 END AS pct
    FROM (VALUES {', '.join(f"('{k}', CAST({b} AS DOUBLE), CAST({n} AS DOUBLE))" for k, b, n in CASES)}) t(key, b, n)""",
)
def improvement_cases(spark, sf_dir):
    return spark.createDataFrame(CASES, "key string, base double, next double").withColumn("pct", report.improvement(F.col("base"), F.col("next"), F.col("key")))


@query("metric_keys", f"WITH {SAMPLES}, {ROWS} SELECT key FROM mr UNION SELECT unnest(['textlintPer1k', 'meanSentenceLength', 'longSentenceRatio', 'tenPerSentence', 'kanjiRatio', 'jreadability']) AS key")
def metric_keys(spark, sf_dir):
    return report.metric_keys(metrics(samples(spark, sf_dir)))


@query("metric_rows_merge", f"""WITH {SAMPLES}, {ROWS}, ru AS (SELECT 'e' || doc_id AS sampleId, avg(quality + 2 * toxic) AS v FROM labels GROUP BY doc_id)
    SELECT * FROM mr UNION ALL SELECT sampleId, unnest(['judgeReadability', 'judgeClarity', 'judgeNaturalness', 'judgeConcision', 'judgeStructure', 'judgeOverall']) AS key, v AS value FROM ru WHERE v IS NOT NULL""")
def metric_rows_merge(spark, sf_dir):
    ev = samples(spark, sf_dir)
    score = (F.col("quality") + 2 * F.col("toxic")).cast("int")
    rubric = table(spark, sf_dir, "labels").select(F.lit("rubric").alias("kind"), F.concat(F.lit("e"), "doc_id").alias("sampleId"), F.struct(*[score.alias(k) for k in report.RUBRIC_KEYS]).alias("scores"))
    scores = ev.select(F.col("id").alias("sampleId"), F.create_map(F.lit("textlintPer1k"), F.col("cents"), F.lit("jreadability"), F.col("k")).alias("metrics"))
    return report.metric_rows(scores, rubric)


@query("metric_wide", f"WITH {SAMPLES}, {ROWS}, {CELLS} SELECT modelId, interventionId, {R4.format('avg(value) FILTER (key = $$textlintPer1k$$)')} AS textlintPer1k, {R4.format('avg(value) FILTER (key = $$jreadability$$)')} AS jreadability FROM cr GROUP BY ALL")
def metric_wide(spark, sf_dir):
    ev = samples(spark, sf_dir)
    return report.wide(report.cell_statistics(metrics(ev), ev), report.CELL, ["textlintPer1k", "jreadability"])


RULES = "ru AS (SELECT interventionId, 'rule-' || (event_id % 5) AS rule, CAST(k AS BIGINT) AS n FROM ev)"


@query("rule_totals", f"WITH {SAMPLES}, {RULES} SELECT interventionId, rule, CAST(sum(n) AS BIGINT) AS total FROM ru GROUP BY ALL")
def rule_totals(spark, sf_dir):
    return report.rule_totals(rules(spark, sf_dir))


def rules(spark, sf_dir):
    return samples(spark, sf_dir).select("interventionId", F.create_map(F.concat(F.lit("rule-"), F.col("event_id") % 5), F.col("k").cast("long")).alias("textlintRules"))


@query("rule_matrix", f"WITH {SAMPLES}, {RULES} SELECT rule, {', '.join(f'CAST(coalesce(sum(n) FILTER (interventionId = $${i}$$), 0) AS BIGINT) AS {i}' for i in ('baseline', 'click', 'purchase', 'signup', 'error'))} FROM ru GROUP BY rule")
def rule_matrix(spark, sf_dir):
    return report.rule_matrix(report.rule_totals(rules(spark, sf_dir)), ["baseline", "click", "purchase", "signup", "error"])


# --- pairs and verdicts

MODEL_PAIRS = """mp AS (SELECT 'models' AS scheme, x.sourceId, x.id AS a, y.id AS b FROM ev x JOIN ev y ON x.sourceId = y.sourceId AND x.sampleIndex = y.sampleIndex AND x.modelId < y.modelId
 WHERE x.interventionId = 'baseline' AND y.interventionId = 'baseline' AND x.error IS NULL AND y.error IS NULL)"""
JUDGED = f"""{PAIRED}, {MODEL_PAIRS}, ps AS (SELECT 'interventions' AS scheme, sourceId, id AS a, baseId AS b FROM pr UNION ALL SELECT * FROM mp),
 hv AS (SELECT ps.*, CASE WHEN abs(x.cents - y.cents) < 3 THEN 'tie' WHEN x.cents > y.cents THEN 'A' ELSE 'B' END AS ab, CASE WHEN x.k > y.k THEN 'A' WHEN x.k < y.k THEN 'B' ELSE 'tie' END AS ba
 FROM ps JOIN ev x ON x.id = a JOIN ev y ON y.id = b), ve AS (SELECT scheme, a, b, CASE WHEN ab = ba THEN ab ELSE 'tie' END AS verdict FROM hv)"""


@query("pairs_interventions", f"WITH {SAMPLES}, {PAIRED} SELECT 'interventions' AS scheme, sourceId, id AS a, baseId AS b FROM pr")
def pairs_interventions(spark, sf_dir):
    return pairs.intervention_pairs(samples(spark, sf_dir))


@query("pairs_models", f"WITH {SAMPLES}, {MODEL_PAIRS} SELECT * FROM mp")
def pairs_models(spark, sf_dir):
    return pairs.model_pairs(samples(spark, sf_dir))


def judged(spark, sf_dir):
    """Both orders of each pair: one goes by cents, one by k."""
    ev = samples(spark, sf_dir)
    side = lambda s: ev.select(F.col("id").alias(s), F.col("cents").alias(f"c{s}"), F.col("k").alias(f"k{s}"))
    both = pairs.scheme_pairs(ev, ["interventions", "models"]).join(side("a"), "a").join(side("b"), "b")
    ba = report.flip(F.when(F.col("kb") > F.col("ka"), "A").when(F.col("kb") < F.col("ka"), "B").otherwise("tie"))
    return both.select("scheme", "a", "b", report.combine(judge.mock_verdict(F.col("ca"), F.col("cb")), ba).alias("verdict"))


@query("pairwise_verdicts", f"WITH {SAMPLES}, {JUDGED} SELECT * FROM ve")
def pairwise_verdicts(spark, sf_dir):
    return judged(spark, sf_dir)


IW = f"iw AS (SELECT modelId, interventionId, {WIN} FROM ve JOIN ev ON ev.id = a WHERE scheme = 'interventions' GROUP BY ALL)"


@query("winrate_cells", f"WITH {SAMPLES}, {JUDGED}, {IW} SELECT *, {RATE} FROM iw")
def winrate_cells(spark, sf_dir):
    return report.intervention_wins(judged(spark, sf_dir), samples(spark, sf_dir))


FLIPPED = "CASE verdict WHEN 'A' THEN 'B' WHEN 'B' THEN 'A' ELSE 'tie' END"


@query("winrate_models", f"WITH {SAMPLES}, {JUDGED}, sd AS (SELECT a AS id, verdict FROM ve WHERE scheme = 'models' UNION ALL SELECT b, {FLIPPED} FROM ve WHERE scheme = 'models'), w AS (SELECT modelId, {WIN} FROM sd JOIN ev USING (id) GROUP BY ALL) SELECT *, {RATE} FROM w")
def winrate_models(spark, sf_dir):
    return report.model_wins(judged(spark, sf_dir), samples(spark, sf_dir))


@query("winrate_merge", f"WITH {SAMPLES}, {JUDGED}, {IW}, w AS (SELECT interventionId, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('wins', 'losses', 'ties'))} FROM iw GROUP BY ALL) SELECT *, {RATE} FROM w")
def winrate_merge(spark, sf_dir):
    return report.merge_wins(report.intervention_wins(judged(spark, sf_dir), samples(spark, sf_dir)), ["interventionId"])


@query("judge_selection", f"WITH {SAMPLES} SELECT modelId AS judgeModel, count(*) AS n FROM ev WHERE modelId = (SELECT min(modelId) FROM ev) GROUP BY ALL")
def judge_selection(spark, sf_dir):
    ev = samples(spark, sf_dir).withColumnRenamed("modelId", "judgeModel")
    return ev.filter(F.col("judgeModel") == report.judge_of(ev)).groupBy("judgeModel").agg(F.count("*").alias("n"))


# --- logs

LOG = "lg AS (SELECT user_id || '-' || event_type AS sampleId, props, CAST(floor(value * 100 + 0.5) AS BIGINT) AS cents, event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events)"
LAST = "la AS (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY sampleId ORDER BY seq DESC) = 1)"


@query("lww_samples", f"WITH {LOG}, {LAST} SELECT la.sampleId, la.event_id, la.props, f.event_id AS first_event FROM la JOIN (SELECT * FROM lg QUALIFY row_number() OVER (PARTITION BY sampleId ORDER BY seq) = 1) f USING (sampleId)")
def lww_samples(spark, sf_dir):
    return store.last_wins(event_log(spark, sf_dir), ["sampleId"]).select("sampleId", "event_id", "props", F.col("_ord.event_id").alias("first_event"))


JLOG = """jl AS (SELECT CASE event_id % 2 WHEN 0 THEN 'rubric' ELSE 'pairwise' END AS kind, 'j' || (event_id % 3) AS judgeModel, 's' || user_id AS sampleId, 'models' AS scheme, 's' || user_id AS a, 's' || (user_id + event_id % 4) AS b, event_id FROM events)"""


@query("lww_judgments", f"WITH {JLOG} SELECT kind, judgeModel, CASE kind WHEN 'rubric' THEN 'rubric|' || judgeModel || '|' || sampleId ELSE 'pairwise|' || judgeModel || '|' || scheme || '|' || a || '|' || b END AS key, max(event_id) AS event_id FROM jl GROUP BY ALL")
def lww_judgments(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 2 == 0, "rubric").otherwise("pairwise").alias("kind"), F.concat(F.lit("j"), F.col("event_id") % 3).alias("judgeModel"), F.concat(F.lit("s"), "user_id").alias("sampleId"), F.lit("models").alias("scheme"),
        F.concat(F.lit("s"), "user_id").alias("aSampleId"), F.concat(F.lit("s"), F.col("user_id") + F.col("event_id") % 4).alias("bSampleId"), "event_id", F.col("event_id").alias("_seq"),
    )
    return store.last_wins(log.withColumn("key", store.judgment_key()), ["key"]).select("kind", "judgeModel", "key", "event_id")


@query("persisted_ids", f"WITH {LOG} SELECT DISTINCT sampleId AS id FROM lg")
def persisted_ids(spark, sf_dir):
    return store.persisted_ids(event_log(spark, sf_dir).withColumnRenamed("sampleId", "id"))


@query("current_hashes", f"WITH {SAMPLES} SELECT id, sha256(text) AS hash FROM ev WHERE error IS NULL")
def current_hashes(spark, sf_dir):
    return store.current_hashes(samples(spark, sf_dir))


def score_log(spark, sf_dir):
    """A score's text hash is of the event's own properties; the scored text is what the user's last event of the kind has."""
    return event_log(spark, sf_dir).select("sampleId", F.sha2("props", 256).alias("textHash"), F.when(F.col("event_id") % 5 == 0, "old").otherwise("now").alias("scoringHash"), "cents", F.col("_seq"))


def texts_now(spark, sf_dir):
    first = store.last_wins(event_log(spark, sf_dir), ["sampleId"])
    return first.select(F.col("sampleId").alias("id"), F.sha2(F.when(F.col("user_id") % 3 == 0, F.lit("changed")).otherwise(F.col("props")), 256).alias("hash"))


@query("fresh_scores", f"WITH {LOG}, {LAST} SELECT sampleId, sha256(props) AS textHash, cents FROM la WHERE user_id % 3 <> 0 AND event_id % 5 <> 0")
def fresh_scores(spark, sf_dir):
    return store.fresh_scores(score_log(spark, sf_dir), texts_now(spark, sf_dir), "now").select("sampleId", "textHash", "cents")


@query("fresh_judgments", f"""WITH {LOG}, {LAST}, j AS (SELECT *, CASE event_id % 2 WHEN 0 THEN 'rubric' ELSE 'pairwise' END AS kind FROM la),
    h AS (SELECT sampleId, CASE WHEN user_id % 3 = 0 THEN 'changed' ELSE props END AS now FROM la)
    SELECT kind, j.sampleId, event_id FROM j JOIN h USING (sampleId) WHERE props = now AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0""")
def fresh_judgments(spark, sf_dir):
    last = store.last_wins(event_log(spark, sf_dir), ["sampleId"])
    log = last.select(
        F.when(F.col("event_id") % 2 == 0, "rubric").otherwise("pairwise").alias("kind"), "sampleId", F.sha2("props", 256).alias("textHash"), F.lit("models").alias("scheme"), F.lit("src").alias("sourceId"),
        F.col("sampleId").alias("aSampleId"), F.col("sampleId").alias("bSampleId"), F.sha2("props", 256).alias("aTextHash"), F.sha2("props", 256).alias("bTextHash"),
        F.when(F.col("event_id") % 11 == 0, "other").otherwise("ctx").alias("contextHash"), F.when(F.col("event_id") % 13 == 0, "other").otherwise("cfg").alias("judgeConfigHash"), F.lit("j").alias("judgeModel"),
        F.when(F.col("event_id") % 7 == 0, "old").when(F.col("event_id") % 2 == 0, "rubric-v2").otherwise("pairwise-v2").alias("promptVersion"), "event_id", F.col("event_id").alias("_seq"),
    )
    contexts = spark.createDataFrame([("src", "ctx")], "sourceId string, contextHash string")
    judges = spark.createDataFrame([("j", "cfg")], "judgeModel string, judgeConfigHash string")
    return store.fresh_judgments(log, texts_now(spark, sf_dir), contexts, judges).select("kind", "sampleId", "event_id")


@query("fresh_closure", """WITH RECURSIVE c AS (SELECT c_custkey AS n, c_custkey % 131 = 4 AS changed, c_custkey % 100 > 0 AS reuses FROM customer),
    f AS (SELECT n FROM c WHERE NOT reuses UNION ALL SELECT c.n FROM f JOIN c ON c.n = f.n + 1 AND c.reuses JOIN c p ON p.n = f.n AND NOT p.changed) SELECT 'c' || n AS id FROM f""")
def fresh_closure(spark, sf_dir):
    """Chains of customers: each takes over the one before, a hundred in a row; one in 131 changed after it was taken over."""
    n = F.col("c_custkey")
    now = lambda c: F.concat(F.lit("text "), c.cast("string"))
    parent = F.concat(F.lit("c"), (n - 1).cast("string"))
    recorded = F.sha2(F.when((n - 1) % 131 == 4, F.lit("before")).otherwise(now(n - 1)), 256)
    step = F.struct(F.lit("generate").alias("type"), F.when(n % 100 > 0, parent).alias("reusedFrom"), F.when(n % 100 > 0, recorded).alias("reusedHash"))
    log = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), n.cast("string")).alias("id"), now(n).alias("text"), F.lit(None).cast("string").alias("error"), F.array(step).alias("steps"), n.alias("_seq"))
    return store.fresh_samples(log).select("id")


@query("expected_cells", """SELECT n_name AS sourceId, coalesce('m' || m, 'none') AS modelId, i AS interventionId, n_regionkey AS sameAs, count(*) OVER (PARTITION BY n_regionkey, m, i) AS alike
    FROM nation, (VALUES (NULL), (1), (2)) a(m), (VALUES ('baseline'), ('fix'), ('rewrite')) b(i)""")
def expected_cells(spark, sf_dir):
    """Cells of every source, model and intervention; those of one region's nations, which have the same prompt, have the same provenance, and no others."""
    sources = table(spark, sf_dir, "nation").select(F.col("n_name").alias("id"), F.lit("task").alias("sourceType"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("audience"), F.concat(F.lit("about "), "n_regionkey").alias("prompt"), F.lit(None).cast("string").alias("text"))
    every = [{"id": "baseline", "steps": [{"type": "generate"}]}, {"id": "fix", "steps": [{"type": "generate", "reuse": "baseline"}, {"type": "textlint-fix"}]}, {"id": "rewrite", "steps": [{"type": "generate"}, {"type": "rewrite", "prompt": "p"}]}]
    cells = pipeline.expected_hashes(sources, every, [{"id": "m1", "provider": "mock", "model": "a"}, {"id": "m2", "provider": "mock", "model": "b"}])
    alike = F.count("*").over(Window.partitionBy("expectedHash"))
    return cells.join(table(spark, sf_dir, "nation").select(F.col("n_name").alias("sourceId"), F.col("n_regionkey").alias("sameAs")), "sourceId").select("sourceId", "modelId", "interventionId", "sameAs", alike.alias("alike"))


@query("log_order", "SELECT 'u' || user_id AS k, max(event_id) AS event_id FROM events GROUP BY user_id")
def log_order(spark, sf_dir):
    """A log in two appends, numbered: the last record of a user by number is read back as the last, whatever files it is in."""
    path = folder(spark, "log")
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("k"), "event_id")
    logs.append_log(events.filter("event_id % 2 = 0").withColumn("_seq", F.col("event_id")), path)
    logs.append_log(events.filter("event_id % 2 = 1").withColumn("_seq", F.col("event_id")), path)
    return store.last_wins(logs.read_log(spark, path, "k string, event_id bigint"), ["k"]).select("k", "event_id")


@query("snapshot_round_trip", "SELECT o_orderkey, o_orderpriority FROM orders")
def snapshot_round_trip(spark, sf_dir):
    path = folder(spark, "snapshot")
    logs.write_snapshot(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").coalesce(1), path)
    return logs.read_snapshot(spark, path, "o_orderkey bigint, o_orderpriority string")


@query("todo_antijoin", f"WITH {SAMPLES} SELECT id FROM ev WHERE error IS NULL AND text <> '' AND event_id % 4 <> 1")
def todo_antijoin(spark, sf_dir):
    ev = samples(spark, sf_dir)
    return store.todo(pairs.usable(ev), ev.filter("event_id % 4 = 1").select("id"), ["id"]).select("id")


@query("budget_limit", f"WITH {SAMPLES} SELECT id FROM ev WHERE error IS NULL AND event_id % 4 <> 1 ORDER BY event_id LIMIT 25")
def budget_limit(spark, sf_dir):
    ev = samples(spark, sf_dir)
    return store.budget(store.todo(pairs.usable(ev), ev.filter("event_id % 4 = 1").select("id"), ["id"]), ["event_id"], 25).select("id")


@query("counts_block", f"WITH {SAMPLES}, {VOTES} SELECT (SELECT count(*) FROM ev) AS samples, (SELECT count(error) FROM ev) AS errors, (SELECT count(*) FROM ev WHERE error IS NULL) AS scores, (SELECT count(*) FROM labels WHERE quality = 1) AS rubric, (SELECT count(*) FROM labels WHERE quality = 0) AS pairwise, (SELECT count(*) FROM vo) AS humanVotes")
def counts_block(spark, sf_dir):
    ev = samples(spark, sf_dir)
    judgments = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "rubric").when(F.col("quality") == 0, "pairwise").alias("kind"))
    return report.counts(ev, ev.filter(store.succeeded()), judgments, votes(spark, sf_dir))


# --- people


@query("vote_tally", f"WITH {VOTES}, {TALLY} SELECT * FROM tv")
def vote_tally(spark, sf_dir):
    return human.tallies(votes(spark, sf_dir))


@query("inter_rater", f"WITH {VOTES}, p AS (SELECT raterId || pairId AS pairId, count(*) AS n, count(DISTINCT choice) = 1 AS alike FROM vo GROUP BY ALL HAVING count(*) >= 2) SELECT count(*) AS pairs, count(*) FILTER (alike) AS agree, floor(count(*) FILTER (alike) / count(*) * 1000.0 + 0.5) / 1000.0 AS rate FROM p")
def inter_rater(spark, sf_dir):
    return human.inter_rater(votes(spark, sf_dir).withColumn("pairId", F.concat("raterId", "pairId")))


@query("median_seconds", f"WITH {VOTES} SELECT raterId, CASE WHEN count(*) % 2 = 0 THEN floor(median(seconds) * 10.0 + 0.5) / 10.0 ELSE median(seconds) END AS medianSeconds FROM vo WHERE seconds IS NOT NULL GROUP BY raterId")
def median_seconds(spark, sf_dir):
    return human.median_seconds(votes(spark, sf_dir), ["raterId"])


@query("human_summary", f"WITH {VOTES} SELECT count(*) AS votes, count(DISTINCT raterId) AS raters FROM vo")
def human_summary(spark, sf_dir):
    return human.summary(votes(spark, sf_dir)).select("votes", "raters")


HUMAN = f"{VOTES}, {TALLY}, hv2 AS (SELECT 'e' || p AS a, 'e' || (p + 1) AS b, verdict FROM (SELECT CAST(substr(pairId, 2) AS BIGINT) AS p, verdict FROM tv))"


def human_verdicts(spark, sf_dir):
    """The vote on user n stands for the pair of events n and n + 1."""
    n = F.substring("pairId", 2, 20).cast("long")
    return human.tallies(votes(spark, sf_dir)).select(F.lit("models").alias("scheme"), F.concat(F.lit("e"), n).alias("a"), F.concat(F.lit("e"), n + 1).alias("b"), "verdict")


@query("human_winrate", f"WITH {SAMPLES}, {HUMAN}, w AS (SELECT modelId, interventionId, {WIN} FROM hv2 JOIN ev ON ev.id = a GROUP BY ALL) SELECT *, {RATE} FROM w")
def human_winrate(spark, sf_dir):
    return report.win_rate(human_verdicts(spark, sf_dir).join(samples(spark, sf_dir).select(F.col("id").alias("a"), *report.CELL), "a"), report.CELL)


@query("human_judge_agreement", f"WITH {SAMPLES}, {HUMAN}, j AS (SELECT x.id AS a, y.id AS b, CASE WHEN abs(x.cents - y.cents) < 3 THEN 'tie' WHEN x.cents > y.cents THEN 'A' ELSE 'B' END AS verdict FROM ev x JOIN ev y ON y.event_id = x.event_id + 1) SELECT count(*) AS n, count(*) FILTER (hv2.verdict = j.verdict) AS agree, floor(count(*) FILTER (hv2.verdict = j.verdict) / count(*) * 1000.0 + 0.5) / 1000.0 AS rate FROM hv2 JOIN j ON hv2.a = j.a AND hv2.b = j.b")
def human_judge_agreement(spark, sf_dir):
    ev = samples(spark, sf_dir).select("id", "event_id", "cents")
    both = ev.join(ev.select(F.col("id").alias("b"), (F.col("event_id") - 1).alias("event_id"), F.col("cents").alias("cb")), "event_id")
    return report.agreement(human_verdicts(spark, sf_dir), both.select(F.col("id").alias("a"), "b", judge.mock_verdict(F.col("cents"), F.col("cb")).alias("verdict")))


@query("vote_validation", """WITH v AS (SELECT event_id AS seq, 'p' || user_id AS pairId, 'r' || (event_id % 7) AS raterId, CASE WHEN event_id % 23 = 0 THEN 'C' ELSE 'A' END AS choice, CASE WHEN event_id % 29 = 0 THEN 20000 ELSE 100 END AS bytes, user_id FROM events),
    e AS (SELECT *, CASE WHEN bytes > 16384 THEN 413 WHEN choice = 'C' THEN 400 WHEN user_id % 10 = 3 THEN 404 END AS early FROM v),
    n AS (SELECT *, CASE WHEN early IS NULL THEN row_number() OVER (PARTITION BY raterId, pairId, early IS NULL ORDER BY seq) END AS nth FROM e),
    b AS (SELECT *, count(*) FILTER (nth = 1) OVER (PARTITION BY raterId ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n)
    SELECT seq, CAST(coalesce(early, CASE WHEN nth > 1 THEN 409 WHEN before >= 40 THEN 403 ELSE 200 END) AS INTEGER) AS status FROM b""")
def vote_validation(spark, sf_dir):
    v = votes(spark, sf_dir).withColumns({"choice": F.when(F.col("_seq") % 23 == 0, "C").otherwise("A"), "bytes": F.when(F.col("_seq") % 29 == 0, 20000).otherwise(100)})
    known = v.filter("user_id % 10 <> 3").select(F.col("pairId").alias("id")).distinct()
    return human.intake(v, known, 40).select(F.col("_seq").alias("seq"), "status")


DRAWS = """a AS (SELECT *, CAST((CAST(seed AS HUGEINT) + (k + 1) * CAST(1831565813 AS HUGEINT)) % 4294967296 AS BIGINT) AS t FROM s),
    b AS (SELECT *, CAST(CAST(xor(t, t >> 15) AS HUGEINT) * CAST(t | 1 AS HUGEINT) % 4294967296 AS BIGINT) AS u FROM a),
    c AS (SELECT *, CAST((CAST(u AS HUGEINT) + CAST(xor(u, u >> 7) AS HUGEINT) * CAST(u | 61 AS HUGEINT) % 4294967296) % 4294967296 AS BIGINT) AS w FROM b),
    d AS (SELECT *, xor(u, w) AS x FROM c), dr AS (SELECT *, CAST(xor(x, x >> 14) AS DOUBLE) / 4294967296.0 AS draw FROM d)"""


RATERS = "ra AS (SELECT DISTINCT raterId FROM v UNION SELECT unnest(['new1', 'new2']))"


@query("assign_pairs", f"""WITH {VOTES}, v AS (SELECT 'r' || seq % 101 AS raterId, 'c' || user_id AS pairId FROM vo), {RATERS}, an AS (SELECT DISTINCT raterId, pairId FROM v JOIN customer ON pairId = 'c' || c_custkey),
    s AS (SELECT raterId, 'c' || c_custkey AS pairId, c_custkey AS k, CAST('0x' || left(sha256('rater' || chr(31) || raterId), 8) AS BIGINT) AS seed FROM ra, customer), {DRAWS},
    o AS (SELECT dr.raterId, dr.pairId, row_number() OVER (PARTITION BY dr.raterId ORDER BY coalesce(n, 0), draw, dr.pairId) AS place, coalesce(done, 0) AS done FROM dr
      LEFT JOIN (SELECT pairId, count(*) AS n FROM v GROUP BY pairId) c ON c.pairId = dr.pairId LEFT JOIN (SELECT raterId, count(*) AS done FROM an GROUP BY raterId) e ON e.raterId = dr.raterId
      WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.raterId = dr.raterId AND an.pairId = dr.pairId))
    SELECT raterId, pairId, CAST(place AS INTEGER) AS place FROM o WHERE place <= greatest(120 - done, 0)""")
def assign_pairs(spark, sf_dir):
    """Every rater's next pairs up to 120 answers in all, two newcomers among them; the pairs are customers, the votes all events."""
    v = votes(spark, sf_dir).withColumns({"raterId": F.concat(F.lit("r"), F.col("_seq") % 101), "pairId": F.concat(F.lit("c"), "user_id")})
    every = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("pairId"), F.col("c_custkey").alias("ord"))
    raters = v.select("raterId").distinct().union(spark.createDataFrame([("new1",), ("new2",)], "raterId string"))
    return human.assign(every, v, raters, 120)


@query("random_draws", f"""WITH s AS (SELECT n_nationkey AS k, seed FROM nation, (VALUES (0), (42), (3735928559), (4294967295)) v(seed)), {DRAWS} SELECT CAST(k AS INTEGER) AS k, CAST(seed AS BIGINT) AS seed, draw FROM dr""")
def random_draws(spark, sf_dir):
    seeds = spark.createDataFrame([(s,) for s in (0, 42, 0xDEADBEEF, 0xFFFFFFFF)], "seed bigint")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).crossJoin(seeds).withColumn("draw", compat.random_draw(F.col("seed"), F.col("k")))


@query("vote_choices", f"WITH {VOTES} SELECT seq, CASE WHEN side = 'tie' THEN 'tie' WHEN (side = 'left') = leftWasA THEN 'A' ELSE 'B' END AS choice FROM (SELECT *, CASE seq % 5 WHEN 0 THEN 'tie' WHEN 1 THEN 'left' WHEN 2 THEN 'left' ELSE 'right' END AS side FROM vo)")
def vote_choices(spark, sf_dir):
    side = F.when(F.col("_seq") % 5 == 0, "tie").when((F.col("_seq") % 5).isin(1, 2), "left").otherwise("right")
    return votes(spark, sf_dir).select(F.col("_seq").alias("seq"), human.choice_of(side, F.col("leftWasA")).alias("choice"))


# --- plans


@query("run_matrix", "SELECT 'c' || c_custkey || '__' || m || '__' || i || '__' || n AS id FROM customer, (VALUES ('m1'), ('m2')) a(m), (VALUES ('baseline'), ('fix')) b(i), (VALUES (0), (1)) c(n)")
def run_matrix(spark, sf_dir):
    sources = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("sourceId"), F.lit("task").alias("sourceType"))
    two = [{"id": i, "steps": [{"type": "generate"}]} for i in ("baseline", "fix")]
    return planning.matrix(sources, planning.choices(spark, two, ["m1", "m2"], two), 2).select(planning.sample_id().alias("id"))


@query("plan_jobs", "SELECT 'c' || c_custkey || '__none__' || i AS cell, count(*) AS jobs FROM customer, (VALUES ('baseline'), ('fix')) b(i) WHERE NOT (i = 'baseline' AND c_custkey % 3 = 0) GROUP BY ALL")
def plan_jobs(spark, sf_dir):
    """Fixing given texts takes over their baseline, which a third of the sources have."""
    sources = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("sourceId"), F.lit("corpus").alias("sourceType"), "c_custkey")
    every = [{"id": "baseline", "steps": [{"type": "generate"}]}, {"id": "fix", "steps": [{"type": "generate", "reuse": "baseline"}, {"type": "textlint-fix"}]}]
    fresh = sources.filter("c_custkey % 3 = 0").select(F.concat("sourceId", F.lit("__none__baseline__0")).alias("id"))
    plan = planning.plan_jobs(sources.drop("c_custkey"), [every[1]], ["m1"], every, fresh, fresh)
    return plan.jobs.groupBy(planning.cell_id().alias("cell")).agg(F.count("*").alias("jobs"))


@query("over_index", "SELECT 'o' || o_custkey || '__' || o_orderkey % 7 AS id FROM orders WHERE o_orderkey % 7 >= 3 AND o_custkey % 2 = 0")
def over_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ids = orders.select(F.concat(F.lit("o"), "o_custkey", F.lit("__"), (F.col("o_orderkey") % 7).cast("string")).alias("id"))
    return planning.extra_samples(ids, orders.filter("o_custkey % 2 = 0").select(F.concat(F.lit("o"), "o_custkey").alias("cell")).distinct(), 3)


@query("unique_ids", "SELECT n_regionkey, count(*) AS count FROM nation GROUP BY ALL HAVING count(*) > 1")
def unique_ids(spark, sf_dir):
    from .sources.definitions import duplicate_ids

    return duplicate_ids(table(spark, sf_dir, "nation"), "n_regionkey")


@query("fk_violations", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL AND s_acctbal < 0)")
def fk_violations(spark, sf_dir):
    """Customers of nations without a supplier in debt."""
    from .sources.definitions import missing_references

    return missing_references(table(spark, sf_dir, "customer"), "c_nationkey", table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select("s_nationkey").distinct(), "s_nationkey").select("c_custkey")


# --- texts

#: Written by hand for the SQL, apart from the patterns of functions/, so that a wrong one there shows.
W = r"[\t\n\x0B\x0C\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SQL_SENTENCE = "[^。！？!?]*[。！？!?][」』）)]?|[^。！？!?]+"
SQL_KANJI = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}々"
SQL_SCRIPTS = {"kanji": SQL_KANJI, "hiragana": "\\x{3040}-\\x{309F}", "katakana": "\\x{30A0}-\\x{30FF}", "latin": "a-zA-Z"}
SQL_NOMINAL = "こと(?:が|を|は|に|も|で)|という|というもの|ものである|ものです|ことができ|を行(?:う|い|っ)|において|における|に関して|に対して"
SQL_UNTOUCHED = f"^{W}*(#|[-*]|[0-9]+\\.|```)"
SQL_REWRITES = [
    ("することができます", "できます"), ("することができる", "できる"), ("を行います", "します"), ("を行う", "する"), ("を実施し", "し"), ("ということ", "こと"), ("というもの", "もの"), ("において", "で"), ("における", "の"), ("に関して", "について"),
    ("ではないでしょうか", "でしょう"), ("(です|ます)が、", "\\1。"), ("(る|た|い)が、", "\\1。"), ("ており、", "ています。"), ("ものの、", "ました。ただし、"),
]
SQL_MARKS = [
    (f"(?m)^{W}{{0,3}}#{{1,6}}{W}+", ""), (f"(?m)^{W}{{0,3}}(=+|-+){W}*$", ""), (f"(?m)^{W}*[-*+]{W}+", ""), (f"(?m)^{W}*[0-9]+[.)]{W}+", ""), (f"(?m)^{W}*>{W}?", ""),
    (f"(?m)^{W}*\\|?{W}*:?-+:?{W}*(\\|{W}*:?-+:?{W}*)*\\|?{W}*$", ""), ("\\|", " "), ("\\*\\*([^*]+)\\*\\*", "\\1"), ("\\[([^\\]]+)\\]\\([^)]*\\)", "\\1"), ("[ \\t]+", " "),
]
JAPANESE = [
    (1, "これは文です。これも文です！これは？最後"),
    (2, "「はい。」と言った。"),
    (3, "設定を行うことができます。それは、長い、文、です、という、ものです。東京都立中央図書館は休みです。"),
    (4, "  空白　と NBSP　です。 English Text! カタカナ語もあります"),
    (5, ""),
    (6, "𠮷野家で食べる。資料に関して、会議において、説明を行います。"),
    (7, "することができます、を実施した、ということです。しかし、長くなりますが、続きます。ものの、終わった。"),
    (8, "雨が降っており、道がぬれている。人々は日々、佐々木さんに対して礼を言う。"),
]
VALUES = ", ".join(f"({i}, '{s}')" for i, s in JAPANESE)
ALL_TEXTS = f"tx AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'j' || i, t FROM (VALUES {VALUES}) v(i, t))"
#: Markdown marks off a text; inline code needs what RE2 lacks and is in no document.
STRIPPED = "text"
for _pattern, _new in SQL_MARKS:
    STRIPPED = f"regexp_replace({STRIPPED}, '{_pattern}', '{_new}', 'g')"
SENTENCES = f"""{ALL_TEXTS}, ln AS (SELECT id, unnest(regexp_split_to_array({STRIPPED}, '\\n+')) AS line FROM tx),
 tr AS (SELECT id, regexp_replace(line, '^{W}+|{W}+$', '', 'g') AS line FROM ln),
 pt AS (SELECT id, unnest(regexp_extract_all(line, '{SQL_SENTENCE}')) AS s FROM tr WHERE line <> ''),
 se AS (SELECT id, regexp_replace(s, '^{W}+|{W}+$', '', 'g') AS s FROM pt WHERE regexp_replace(s, '^{W}+|{W}+$', '', 'g') <> '')"""
UNITS = r"(length(@) + length(regexp_replace(@, '[^\x{10000}-\x{10FFFF}]', '', 'g')))"


def texts(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"))
    return docs.union(spark.createDataFrame([(f"j{i}", t) for i, t in JAPANESE], "id string, text string"))


def plain_texts(spark, sf_dir):
    return texts(spark, sf_dir).select("id", text.strip_markdown(F.col("text")).alias("plain"))


@query("sentence_split", f"WITH {SENTENCES} SELECT id, s AS sentence, count(*) AS n FROM se GROUP BY ALL")
def sentence_split(spark, sf_dir):
    return plain_texts(spark, sf_dir).select("id", F.explode(text.split_sentences(F.col("plain"))).alias("sentence")).groupBy("id", "sentence").agg(F.count("*").alias("n"))


SQUEEZED = f"regexp_replace(s, '{W}+', '', 'g')"
LENGTHS = f"le AS (SELECT id, s, {UNITS.replace('@', SQUEEZED)} AS n, length(s) - length(replace(s, '、', '')) AS c FROM se)"


@query("sentence_stats", f"""WITH {SENTENCES}, {LENGTHS} SELECT tx.id, count(s) AS sentences, coalesce(sum(n), 0) / greatest(count(s), 1) AS meanSentenceLength, CAST(coalesce(max(n), 0) AS BIGINT) AS maxSentenceLength,
    count(*) FILTER (n > 60) / greatest(count(s), 1) AS longSentenceRatio, count(*) FILTER (n > 100) / greatest(count(s), 1) AS veryLongSentenceRatio, coalesce(sum(c), 0) / greatest(count(s), 1) AS tenPerSentence, count(*) FILTER (c >= 4) / greatest(count(s), 1) AS manyTenRatio
    FROM tx LEFT JOIN le ON le.id = tx.id GROUP BY tx.id""")
def sentence_stats(spark, sf_dir):
    return text.with_surface(texts(spark, sf_dir)).select("id", "sentences", "meanSentenceLength", "maxSentenceLength", "longSentenceRatio", "veryLongSentenceRatio", "tenPerSentence", "manyTenRatio")


BODY = f"{ALL_TEXTS}, bo AS (SELECT id, text, regexp_replace({STRIPPED}, '{W}+', '', 'g') AS body FROM tx), bc AS (SELECT *, {UNITS.replace('@', 'body')} AS chars FROM bo)"
SCRIPTS = SQL_SCRIPTS


@query("script_ratios", f"WITH {BODY} SELECT id, chars, {', '.join(f'length(regexp_replace(body, $$[^{s}]$$, $$$$, $$g$$)) / greatest(chars, 1) AS {k}Ratio' for k, s in SCRIPTS.items())} FROM bc")
def script_ratios(spark, sf_dir):
    return text.with_surface(texts(spark, sf_dir)).select("id", "chars", *[f"{k}Ratio" for k in SCRIPTS])


@query("max_run", f"WITH {BODY} SELECT id, CAST(coalesce(list_max(list_transform(regexp_extract_all(body, '[{SQL_KANJI}]+'), lambda x: length(x))), 0) AS BIGINT) AS maxKanjiRun FROM bc")
def max_run(spark, sf_dir):
    return text.with_surface(texts(spark, sf_dir)).select("id", "maxKanjiRun")


@query("nominalization", f"WITH {BODY} SELECT id, len(regexp_extract_all(text, '{SQL_NOMINAL}')) / greatest(chars, 1) * 1000.0 AS nominalizationPer1k FROM bc")
def nominalization(spark, sf_dir):
    return text.with_surface(texts(spark, sf_dir)).select("id", "nominalizationPer1k")


@query("paragraphs", f"WITH {ALL_TEXTS}, p AS (SELECT id, unnest(regexp_split_to_array(text, '\\n{W}*\\n')) AS p FROM tx) SELECT id, count(*) FILTER (regexp_replace(p, '{W}+', '', 'g') <> '') AS paragraphs FROM p GROUP BY id")
def paragraphs(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.size(text.split_paragraphs(F.col("text"))).cast("long").alias("paragraphs"))


MD = "md AS (SELECT doc_id, '## ' || source || chr(10) || chr(10) || '- ' || lang || chr(10) || '> **' || lang || '** | x' || chr(10) || chr(10) || 'title' || chr(10) || '=====' || chr(10) || text AS t FROM documents)"


def markdown(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.expr("concat('## ', source, '\n\n- ', lang, '\n> **', lang, '** | x\n\ntitle\n=====\n', text)").alias("t"))


@query("strip_markdown_basic", f"WITH {MD} SELECT doc_id, {STRIPPED} AS plain FROM (SELECT doc_id, t AS text FROM md)")
def strip_markdown_basic(spark, sf_dir):
    return markdown(spark, sf_dir).select("doc_id", text.strip_markdown(F.col("t")).alias("plain"))


@query("headings_lists", f"WITH {MD} SELECT doc_id, CAST(2 AS BIGINT) AS headings, CAST(1 AS BIGINT) AS listLines FROM md")
def headings_lists(spark, sf_dir):
    return text.with_surface(markdown(spark, sf_dir), "t").select("doc_id", "headings", "listLines")


@query("remove_code_blocks", "SELECT doc_id, '# a' || chr(10) || chr(10) || text AS t FROM documents")
def remove_code_blocks(spark, sf_dir):
    """A fence and an indented block around each text go; the text stays."""
    fenced = F.expr("concat('# a\n```x\n> y\n```\n', text, '\n\n    code\n\n     more')")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(text.remove_code_blocks(fenced), r"\n\n$", "").alias("t"))


@query("escape_delims", f"SELECT page_id, regexp_replace(html, '(?i)<(/?)(p|li)({W}*)>', '&lt;\\1\\2\\3&gt;', 'g') AS escaped FROM pages")
def escape_delims(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.escape_delimiters(F.col("html"), ["p", "li"]).alias("escaped"))


HEUR = f"""{SENTENCES}, he0 AS (SELECT tx.id, count(s) AS n, coalesce(sum({UNITS.replace('@', 's')}), 0) AS l, count(*) FILTER ({UNITS.replace('@', 's')} > 60) AS o, coalesce(sum(length(s) - length(replace(s, '、', ''))), 0) AS c FROM tx LEFT JOIN se ON se.id = tx.id GROUP BY tx.id),
 he AS (SELECT id, CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, least(100.0, 110.0 - l / greatest(n, 1) - o / greatest(n, 1) * 25.0 - c / greatest(n, 1) * 8.0)) END AS h FROM he0)"""


@query("heuristic_score", f"WITH {HEUR} SELECT id, h FROM he")
def heuristic_score(spark, sf_dir):
    return text.with_heuristic(texts(spark, sf_dir), "text", "h").select("id", "h")


@query("mock_rubric", f"WITH {HEUR}, s AS (SELECT id, CAST(greatest(1, least(5, floor(1 + h / 100.0 * 4 + 0.5))) AS INTEGER) AS s FROM he) SELECT id, s AS overall, least(5, s + 1) AS naturalness, greatest(1, s - 1) AS structure FROM s")
def mock_rubric(spark, sf_dir):
    return judge.with_mock_scores(texts(spark, sf_dir), "text", "s").select("id", "s.overall", "s.naturalness", "s.structure")


@query("mock_pairwise", f"WITH {HEUR} SELECT d.doc_id, CASE WHEN abs(a.h - b.h) < 3 THEN 'tie' WHEN a.h > b.h THEN 'A' ELSE 'B' END AS verdict FROM documents d JOIN he a ON a.id = 'd' || d.doc_id JOIN he b ON b.id = 'd' || (d.doc_id + 1)")
def mock_pairwise(spark, sf_dir):
    h = heuristic_score(spark, sf_dir).filter("id like 'd%'").select(F.substring("id", 2, 20).cast("long").alias("doc_id"), "h")
    return h.join(h.select((F.col("doc_id") - 1).alias("doc_id"), F.col("h").alias("hb")), "doc_id").select("doc_id", judge.mock_verdict(F.col("h"), F.col("hb")).alias("verdict"))


_REWRITTEN = "line"
for _pattern, _new in SQL_REWRITES:
    _REWRITTEN = f"regexp_replace({_REWRITTEN}, '{_pattern}', '{_new}', 'g')"


@query("mock_rewrite", f"WITH {ALL_TEXTS}, ln AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM tx) SELECT id, string_agg(CASE WHEN regexp_matches(line, '{SQL_UNTOUCHED}') THEN line ELSE {_REWRITTEN} END, chr(10) ORDER BY i) AS rewritten FROM ln GROUP BY id")
def mock_rewrite(spark, sf_dir):
    return texts(spark, sf_dir).select("id", text.rewrite(F.col("text")).alias("rewritten"))


@query("text_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", compat.text_hash(F.col("text")).alias("hash"))


@query("pair_ids", f"""WITH {SAMPLES}, {MODEL_PAIRS} SELECT left(sha256(concat_ws(chr(31), 'models', a, b, x.text, y.text, mp.sourceId, '一般的な読者')), 16) AS id, a AS aSampleId, b AS bSampleId FROM mp JOIN ev x ON x.id = a JOIN ev y ON y.id = b""")
def pair_ids(spark, sf_dir):
    nobody = spark.createDataFrame([], "id string, title string, audience string")
    return pairs.human_pairs(samples(spark, sf_dir), nobody, ["models"]).select("id", "aSampleId", "bSampleId")


@query("cache_dedup", "SELECT count(*) AS requests, count(DISTINCT text) AS asked FROM documents")
def cache_dedup(spark, sf_dir):
    """Copies are judged once: every request has an answer, distinct texts are asked about."""
    asked = judge.rubric_requests(table(spark, sf_dir, "documents").select("doc_id", F.lit("s").alias("sourceId"), "text"), spark.createDataFrame([("s", "t", None)], "sourceId string, title string, audience string"), "cfg")
    answers, new = judge.cached(asked.select("cacheKey", "text"), None, lambda df: df.select("cacheKey", F.lit("ok").alias("answer")))
    return asked.join(answers, "cacheKey").agg(F.count("*").alias("requests")).join(new.agg(F.count("*").alias("asked")))


@query("prompt_assembly", "SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Before.' || chr(10) || chr(10) ELSE '' END || text || CASE WHEN item_id % 3 = 0 THEN chr(10) || chr(10) || 'After.' ELSE '' END AS prompt FROM benchmark")
def prompt_assembly(spark, sf_dir):
    part = lambda n, s: F.when(F.col("item_id") % n == 0, s).otherwise("")
    return table(spark, sf_dir, "benchmark").select("item_id", text.prompt_of(part(2, "Before."), F.col("text"), part(3, "After.")).alias("prompt"))


@query("fixture_sections", "SELECT 'd' AS style, 's' || item_id AS id, trim(text) AS body FROM benchmark")
def fixture_sections(spark, sf_dir):
    made = table(spark, sf_dir, "benchmark").select(F.lit("d").alias("style"), F.concat(F.lit("=== s"), "item_id", F.lit(" ===\r\n\r\n"), F.trim("text"), F.lit("\r\n\r\n")).alias("value"))
    return logs.fixture_sections(made)


@query("json_round_trip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_round_trip(spark, sf_dir):
    parsed = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return parsed.select("event_id", F.from_json(F.to_json("p"), "k bigint").getField("k").alias("k"))


@query("finite_metrics", "SELECT event_id, CASE WHEN event_id % 4 = 1 THEN 1 ELSE 2 END AS n FROM events")
def finite_metrics(spark, sf_dir):
    m = F.create_map(F.lit("a"), F.when(F.col("event_id") % 4 == 1, F.lit(float("nan"))).otherwise(F.col("value")), F.lit("b"), F.lit(1.0), F.lit("c"), F.lit(float("inf")))
    return table(spark, sf_dir, "events").select("event_id", F.size(F.map_filter(m, lambda k, v: compat.finite(v))).alias("n"))


PLAIN_LINES = f"pl AS (SELECT id, {STRIPPED} AS plain FROM tx)"
SQL_FIXED = "|".join(p for p, _ in SQL_REWRITES[:11])
LINE_RULES = {"max-kanji-run": f"[{SQL_KANJI}]{{5,}}", "no-redundant-expression": SQL_FIXED, "no-double-negative": "なくはない|ないわけではない|ないことはない|なくもない"}


@query("lint_counts", f"""WITH {SENTENCES}, {LENGTHS}, {PLAIN_LINES}, r AS (SELECT id, 'sentence-length' AS rule, count(*) AS n FROM le WHERE n > 100 GROUP BY id UNION ALL SELECT id, 'max-ten', count(*) FROM le WHERE c > 3 GROUP BY id
    {' '.join(f"UNION ALL SELECT id, '{r}', len(regexp_extract_all(plain, '{p}')) FROM pl" for r, p in LINE_RULES.items())}) SELECT * FROM r WHERE n > 0""")
def lint_counts(spark, sf_dir):
    return lint.with_lint(texts(spark, sf_dir), "text", "m").select("id", F.explode(lint.rule_counts(F.col("m"))).alias("rule", "n"))


# Cases by hand: what goes in and what must come out, so that each rule shows by itself.


def cases(name: str, rows: list[tuple[str, str]], made) -> None:
    """A query over literals whose SQL is the values that must come out. made: the result as a string column of column t."""
    quoted = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"

    @query(name, "SELECT * FROM (VALUES " + ", ".join(f"({n}, {quoted(out)})" for n, (_, out) in enumerate(rows)) + ") v(n, made)")
    def run(spark, sf_dir):
        return spark.createDataFrame([(n, t) for n, (t, _) in enumerate(rows)], "n int, t string").select("n", made(F.col("t")).alias("made"))


cases(
    "rewrite_cases",
    [
        ("読むことをすることができます。", "読むことをできます。"), ("することができる人", "できる人"), ("調査を行います。", "調査します。"), ("調査を行う。", "調査する。"), ("調査を実施し、", "調査し、"), ("ということだ", "ことだ"), ("というもの", "もの"), ("会議において", "会議で"), ("日本における", "日本の"),
        ("件に関して", "件について"), ("ではないでしょうか", "でしょう"), ("長いですが、読む", "長いです。読む"), ("読みますが、書く", "読みます。書く"), ("走るが、止まる", "走る。止まる"), ("走ったが、止まる", "走った。止まる"), ("長いが、読む", "長い。読む"), ("降っており、寒い", "降っています。寒い"),
        ("読むものの、書かない", "読むました。ただし、書かない"), ("# 調査を行う", "# 調査を行う"), ("- 調査を行う\n調査を行う", "- 調査を行う\n調査する"), ("  * を行う", "  * を行う"), ("12. を行う", "12. を行う"), ("```を行う", "```を行う"), ("1) を行う", "1) する"),
    ],
    text.rewrite,
)
cases(
    "markdown_cases",
    [
        ("使う `a b` と ``c `d` e``", "使う X と X"), ("### 題\n本文", "題\n本文"), ("題\n====\n本文", "題\n\n本文"), ("題\n---\n本文", "題\n\n本文"), ("* 一\n+ 二\n- 三", "一\n二\n三"), ("1. 一\n22) 二", "一\n二"), ("> 引用\n>> 二重", "引用\n> 二重"), ("|a|b|\n|:-:|--|\n|c|d|", " a b \n\n c d "),
        ("**太い** 字", "太い 字"), ("[名前](http://x) だ", "名前 だ"), ("a\t \tb", "a b"), ("####### 七", "####### 七"), ("本文 # 途中", "本文 # 途中"), ("```\nコード\n```\n本文", "\n本文"), ("~~~\nコード\n~~~~\n本文", "\n本文"), ("本文\n\n    コード", "本文\n\n"),
        ("````\n```\n````\n文", "\n文"), ("- 項目\n\n    続き", "項目\n\n 続き"), ("- 項目\n\n      コード\n終わり", "項目\n\n\n終わり"), ("> ```\n> x\n> ```\n文", "\n文"), ("```\n閉じない", ""), ("文\n    続く", "文\n 続く"),
    ],
    text.strip_markdown,
)
cases(
    "sentence_cases",
    [
        ("一です。二です！三です？四", "一です。|二です！|三です？|四"), ("「はい。」と言う。", "「はい。」|と言う。"), ("『本。』）次。", "『本。』|）次。"), ("One. Two! Three?", "One. Two!|Three?"), ("一\n\n二\n　三　", "一|二|三"), ("（注。）次", "（注。）|次"), ("本当？！", "本当？|！"), ("(a.) b!) c", "(a.) b!)|c"), ("", ""),
    ],
    lambda t: F.array_join(text.split_sentences(t), "|"),
)
SURFACE_CASES = [
    # text, then kanji, hiragana, katakana, Latin, units, longest run of kanji, lists, headings, circumlocutions
    ("漢字かなカナabc", "2 2 2 3 9 2 0 0 0"), ("人々の㐂び", "3 2 0 0 5 2 0 0 0"), ("𠮷野家", "2 0 0 0 4 2 0 0 0"), ("ーヴぁゟヿ", "0 2 3 0 5 0 0 0 0"), ("一二三、四五", "5 0 0 0 6 3 0 0 0"), ("- a\n* b\n+ c\n3. d\n4) e\n本", "1 0 0 5 6 1 5 0 0"), ("# 題\n副\n===\n文\n---\n|a|\n---", "3 0 0 1 4 3 0 3 0"),
    ("行うことが読むことを書くことはすることに見ることで聞くことも", "5 25 0 0 30 1 0 0 6"), ("というものである", "0 8 0 0 8 0 0 0 2"), ("ものです。ことができ。を行う。を行い。を行っ。において。における。に関して。に対して", "5 29 0 0 42 1 0 0 9"),
]


@query("surface_cases", "SELECT * FROM (VALUES " + ", ".join(f"({n}, '{out}')" for n, (_, out) in enumerate(SURFACE_CASES)) + ") v(n, made)")
def surface_cases(spark, sf_dir):
    df = text.with_surface(spark.createDataFrame([(n, t) for n, (t, _) in enumerate(SURFACE_CASES)], "n int, text string"))
    whole = lambda c: F.round(F.col(c) * F.greatest("chars", F.lit(1))).cast("long")
    said = F.round(F.col("nominalizationPer1k") * F.greatest("chars", F.lit(1)) / 1000).cast("long")
    return df.select("n", F.concat_ws(" ", *[whole(f"{k}Ratio") for k in ("kanji", "hiragana", "katakana", "latin")], "chars", "maxKanjiRun", "listLines", "headings", said).alias("made"))


TOKENS = [
    (1, "東京", "東京", "名詞", "固有名詞"), (1, "は", "は", "助詞", "係助詞"), (1, "検討", "検討", "名詞", "サ変接続"), (1, "する", "する", "動詞", "自立"), (1, "られる", "られる", "動詞", "接尾"), (1, "。", "。", "記号", "句点"),
    (2, "データ", "*", "名詞", "一般"), (2, "ABC123", "*", "名詞", "一般"), (2, "三", "三", "名詞", "数"), (2, "12", "*", "名詞", "数"), (2, "山", "山", "名詞", "一般"), (2, "えっと", "えっと", "フィラー", "*"), (2, "食べる", "食べる", "動詞", "自立"),
]
TOKEN_VALUES = ", ".join(str(t) for t in TOKENS)
ORIGIN = f"""CASE WHEN pos IN ('記号', 'フィラー', 'その他') THEN 'other' WHEN regexp_full_match(s, '[0-9０-９.,]+') THEN 'other' WHEN regexp_full_match(s, '[゠-ヿ]+') OR regexp_full_match(s, '[A-Za-z0-9]+') THEN 'gairaigo'
 WHEN pos = '名詞' AND d = '数' THEN CASE WHEN regexp_full_match(s, '[{SQL_KANJI}]+') THEN 'kango' ELSE 'other' END
 WHEN pos IN ('名詞', '接頭詞') AND (d = 'サ変接続' OR regexp_full_match(s, '[{SQL_KANJI}]+') AND length(s) >= 2) THEN 'kango' ELSE 'wago' END"""
TK = f"tk AS (SELECT *, {ORIGIN} AS origin FROM (VALUES {TOKEN_VALUES}) v(id, s, b, pos, d))"


def token_table(spark):
    return spark.createDataFrame(TOKENS, "sampleId int, surface_form string, basic_form string, pos string, pos_detail_1 string")


@query("goshu_classify", f"WITH {TK} SELECT id AS sampleId, s AS surface_form, origin FROM tk")
def goshu_classify(spark, sf_dir):
    return token_table(spark).select("sampleId", "surface_form", tokens.origin(F.col("surface_form"), F.col("pos"), F.col("pos_detail_1")).alias("origin"))


@query("jreadability_formula", f"""WITH {TK}, w AS (SELECT * FROM tk WHERE pos <> '記号'), g AS (SELECT id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (origin = 'kango') AS DOUBLE) AS k, CAST(count(*) FILTER (origin = 'wago') AS DOUBLE) AS w, CAST(count(*) FILTER (pos = '動詞') AS DOUBLE) AS v, CAST(count(*) FILTER (pos = '助詞') AS DOUBLE) AS p FROM w GROUP BY id)
    SELECT CAST(id AS INTEGER) AS sampleId, CAST(n AS BIGINT) AS tokens, floor((11.724::DOUBLE - 20.0::DOUBLE * 0.056::DOUBLE - k / n * 100 * 0.126::DOUBLE - w / n * 100 * 0.042::DOUBLE - v / n * 100 * 0.145::DOUBLE - p / n * 100 * 0.044::DOUBLE) * 10000.0 + 0.5) / 10000.0 AS jreadability FROM g""")
def jreadability_formula(spark, sf_dir):
    sentences = spark.createDataFrame([(1, 2, 20.0), (2, 1, 20.0)], "sampleId int, sentences int, meanSentenceLength double")
    return tokens.token_metrics(token_table(spark), sentences).select("sampleId", "tokens", compat.round_half_up(F.col("jreadability"), 4).alias("jreadability"))


from . import cases as _more  # noqa: E402, F401  it registers its queries here
