"""Reports on a run of four samples, and parts of them."""

import pytest
from pyspark.sql import functions as F

from lexigauge import schema
from lexigauge.operators import full_report, human, judge, pairs, render, report


@pytest.fixture(scope="module")
def run(spark):
    cells = [("m1-base", "m1", "baseline", 10.0, 80.0, 2.0, 2), ("m1-fix", "m1", "textlint-fix", 5.0, 60.0, 3.0, 1), ("m2-base", "m2", "baseline", 4.0, 40.0, 4.0, 0), ("m2-fix", "m2", "textlint-fix", 4.0, 40.0, 4.0, 0)]
    samples = spark.createDataFrame([(i, "s", m, v, 0, "text", None) for i, m, v, *_ in cells], "id string, sourceId string, modelId string, interventionId string, sampleIndex int, text string, error string")
    scores = spark.createDataFrame([(i, m, v, {"textlintPer1k": a, "meanSentenceLength": b, "jreadability": c}, {"x/a": n} if n else {}) for i, m, v, a, b, c, n in cells], "sampleId string, modelId string, interventionId string, metrics map<string,double>, textlintRules map<string,bigint>")
    rubric = [("rubric", i, None, None, None, None, "j", tuple([n] * 6)) for i, n in (("m1-base", 2), ("m1-fix", 4))]
    pairwise = [("pairwise", None, s, a, b, v, "j", None) for s, a, b, v in (("interventions", "m1-fix", "m1-base", "A"), ("interventions", "m2-fix", "m2-base", "tie"), ("models", "m1-base", "m2-base", "B"))]
    judgments = spark.createDataFrame(rubric + pairwise, f"kind string, sampleId string, scheme string, aSampleId string, bSampleId string, verdict string, judgeModel string, scores struct<{','.join(k + ':int' for k in schema.RUBRIC_KEYS)}>")
    shown = spark.createDataFrame([("p", "interventions", "m1-fix", "m1-base")], "id string, scheme string, aSampleId string, bSampleId string")
    votes = spark.createDataFrame([("p", "A", "r1", 10.0), ("p", "A", "r2", 20.0), ("p", "B", "r3", None), ("stale", "B", "r3", 1.0)], "pairId string, choice string, raterId string, seconds double")
    return samples, scores, judgments, votes, shown


def test_whole(run):
    out = full_report.build(run[0], run[1], run[2], run[3], run[4])
    cell = next(c for c in out["cells"] if (c["modelId"], c["interventionId"]) == ("m1", "textlint-fix"))
    assert cell["changes"]["textlintPer1k"] == {"pct": 50.0, "delta": -5.0, "matchedN": 1, "matched": 1}
    assert cell["changes"]["meanSentenceLength"]["pct"] == 25.0 and cell["changes"]["judgeOverall"]["pct"] == 100.0
    every = next(c for c in out["interventions"] if c["interventionId"] == "textlint-fix")
    assert (every["judge"]["wins"], every["judge"]["ties"], every["judge"]["n"], every["judge"]["rate"]) == (1, 1, 2, 0.75)
    assert every["changes"]["textlintPer1k"]["pct"] == 35.7 and every["changes"]["judgeOverall"]["matchedN"] == 1 and every["changes"]["judgeOverall"]["matched"] == 2
    assert cell["human"]["rate"] == 1.0 and out["agreement"] == {"n": 1, "agree": 1, "rate": 1.0}
    assert out["ruleCounts"] == {"x/a": {"baseline": 2, "textlint-fix": 1}}
    assert {m["modelId"]: m["judge"]["rate"] for m in out["models"]} == {"m1": 0.0, "m2": 1.0}
    assert out["counts"]["humanVotes"] == 3 and out["counts"]["errors"] == 0
    shown = render.markdown(out)
    assert "## Models" in shown and "対 1 件" in shown and "50.0%" in shown


def test_matched_only(spark):
    """A group's composition is no improvement, and a sample without a baseline none either."""
    samples = spark.createDataFrame([("b", "s1", "m", "baseline", 0, None), ("f", "s1", "m", "fix", 0, None), ("o", "s2", "m", "fix", 0, None)], "id string, sourceId string, modelId string, interventionId string, sampleIndex int, error string")
    rows = spark.createDataFrame([("b", "textlintPer1k", 3.0), ("f", "textlintPer1k", 3.0), ("o", "textlintPer1k", 0.0)], "sampleId string, key string, value double")
    got = report.matched_comparison(rows, samples).collect()
    assert [(r["improvementPct"], r["matched"]) for r in got] == [(0.0, 1)]


def test_fallback_baseline(spark):
    samples = spark.createDataFrame([("c", "s", "none", "baseline", 0, "t", None), ("r", "s", "m", "rewrite", 0, "u", None), ("x", "s", "m", "rewrite", 1, "u", None)], "id string, sourceId string, modelId string, interventionId string, sampleIndex int, text string, error string")
    assert [(r["a"], r["b"]) for r in pairs.intervention_pairs(samples).collect()] == [("r", "c")]


@pytest.mark.parametrize("choices, verdict", [("AAB", "A"), ("AB", "tie"), (["tie", "tie", "A"], "tie"), ("BBA", "B")])
def test_majority(spark, choices, verdict):
    votes = spark.createDataFrame([("p", c) for c in choices], "pairId string, choice string")
    assert human.tallies(votes).first()["verdict"] == verdict


def test_votes(run):
    on = human.on_pairs(run[3], run[4])
    row = human.summary(on).first()
    assert (row["votes"], row["raters"], row["pairs"], row["agree"], row["medianSeconds"]) == (3, 3, 1, 0, 15.0)


def test_assignment(spark):
    every = spark.createDataFrame([(f"p{i}", i) for i in range(6)], "pairId string, ord int")
    votes = spark.createDataFrame([("p0", "r"), ("p1", "r")], "pairId string, raterId string")
    got = human.assign(every, votes, spark.createDataFrame([("r",)], "raterId string"), 3).collect()
    assert len(got) == 1 and got[0]["pairId"] not in ("p0", "p1")
    votes = spark.createDataFrame([], "pairId string, raterId string")
    for k in range(6):
        new = human.assign(every, votes, spark.createDataFrame([(f"r{k}",)], "raterId string"), 2).collect()
        votes = spark.createDataFrame([tuple(r) for r in votes.collect()] + [(r["pairId"], r["raterId"]) for r in new], "pairId string, raterId string")
    assert [r["count"] for r in votes.groupBy("pairId").count().collect()] == [2] * 6


def test_intake(spark):
    pairs_ = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "id string")
    rows = [(1, "p1", "r", "A", 10), (2, "p1", "r", "B", 10), (3, "x", "r", "A", 10), (4, "p2", "r", "C", 10), (5, "p2", "r", "tie", 20000), (6, "p2", "r", "tie", 10), (7, "p3", "r", "A", 10)]
    votes = spark.createDataFrame([(*r, True, None) for r in rows], "_seq bigint, pairId string, raterId string, choice string, bytes int, leftWasA boolean, seconds double")
    assert [r["status"] for r in human.intake(votes, pairs_, 2).orderBy("_seq").collect()] == [200, 409, 404, 400, 413, 200, 403]


def test_judging_asks_once(spark):
    asked = []

    def answer(df):
        asked.append(df.count())
        return df.select("cacheKey", F.lit("A").alias("verdict"), F.lit("r").alias("rationale"), F.lit(None).cast("string").alias("error"))

    sources = spark.createDataFrame([("s", "t", None)], "sourceId string, title string, audience string")
    both = spark.createDataFrame([("models", "s", "a", "b", "same", "same"), ("models", "s", "c", "d", "x", "y"), ("models", "s", "e", "f", "y", "x")], "scheme string, sourceId string, a string, b string, aText string, bText string")
    made, _ = judge.judge_pairwise(both, sources, "j", "h", answer)
    got = {r["aSampleId"]: r["verdict"] for r in made.collect()}
    judge.judge_pairwise(both, sources, "j", "h", answer, share=False)
    assert asked == [3, 6] and got == {"a": "tie", "c": "tie", "e": "tie"}  # the first place always wins: no verdict


def test_formats():
    assert render.fixed(1.005, 2) == "1.00" and render.fixed(2.5, 0) == "3" and render.number("kanjiRatio", 0.1234) == "12.3%"
    assert render.percent(None, 2.0) == "(+2.00, 基準 0)"
