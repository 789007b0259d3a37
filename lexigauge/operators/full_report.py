"""The whole report of a run: every table, collected at a report's size."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from . import human, report
from .judge import verdicts


def build(samples: DataFrame, scores: DataFrame, judgments: DataFrame, votes: DataFrame, pairs: DataFrame, baseline: str = "baseline", judge: str | None = None) -> dict[str, Any]:
    """models, cells, interventions, ruleCounts, agreement and counts; see render.markdown()."""
    judge = report.judge_of(judgments, judge)
    judged = judgments.filter(F.col("judgeModel") == judge) if judge else judgments
    rows = written(report.metric_rows(scores, judged))
    verdict = written(verdicts(judged))
    voted = human.on_pairs(votes, pairs)
    people = human.tallies(voted).select("pairId", "verdict").join(pairs.select(F.col("id").alias("pairId"), "scheme", F.col("aSampleId").alias("a"), F.col("bSampleId").alias("b")), "pairId").select("scheme", "a", "b", "verdict")

    def collected(df: DataFrame, *key: str) -> dict[tuple, dict]:
        return {tuple(r[k] for k in key): r.asDict() for r in df.collect()}  # a row for each model, intervention and metric

    stats = report.rollup_statistics(rows, samples).collect()
    cells = collected(report.cell_counts(samples), *report.CELL)
    changes = {by: collected(report.matched_comparison(rows, samples, baseline, list(by)), *by, "key") for by in (tuple(report.CELL), ("interventionId",))}
    cell_wins = {who: report.intervention_wins(v, samples, baseline) for who, v in (("judge", verdict), ("human", people))}
    wins = {who: collected(w, *report.CELL) for who, w in cell_wins.items()}
    merged = {who: collected(report.merge_wins(w, ["interventionId"]), "interventionId") for who, w in cell_wins.items()}
    between = {who: collected(report.model_wins(v, samples, baseline), "modelId") for who, v in (("judge", verdict), ("human", people))}
    by_cell: dict[tuple, dict] = {}
    for s in stats:
        by_cell.setdefault((s["modelId"], s["interventionId"]), {})[s["key"]] = {"mean": s["mean"], "sd": s["sd"], "n": s["n"]}

    def change(by: tuple, at: tuple) -> dict:
        return {k[-1]: {"pct": c["improvementPct"], "delta": c["delta"], "matchedN": c["matchedN"], "matched": c["matched"]} for k, c in changes[by].items() if k[:-1] == at}

    out: dict[str, Any] = {"judge": judge, "cells": [], "interventions": [], "models": []}
    place = report.ranks(samples.sparkSession, sorted({x for key in cells for x in key}))
    for (m, i), c in sorted(cells.items(), key=lambda x: [place[k] for k in x[0]]):
        row = {"modelId": m, "interventionId": i, "samples": c["samples"], "errors": c["errors"], "stats": by_cell.get((m, i), {}), "judge": wins["judge"].get((m, i)), "human": wins["human"].get((m, i))}
        out["cells"].append(row | ({"changes": change(tuple(report.CELL), (m, i))} if i != baseline else {}))
        if i == baseline and m != report.NO_MODEL:
            out["models"].append(row | {"judge": between["judge"].get((m,)), "human": between["human"].get((m,))})
    for i in sorted({i for _, i in cells}, key=place.get):
        total = {k: sum(c[k] for (_, x), c in cells.items() if x == i) for k in ("samples", "errors")}
        row = {"modelId": "*", "interventionId": i, **total, "stats": by_cell.get(("*", i), {}), "judge": merged["judge"].get((i,)), "human": merged["human"].get((i,))}
        out["interventions"].append(row | ({"changes": change(("interventionId",), (i,))} if i != baseline else {}))
    rules: dict[str, dict[str, int]] = {}
    for r in report.rule_totals(scores).collect():
        rules.setdefault(r["rule"], {})[r["interventionId"]] = r["total"]
    out["ruleCounts"] = rules
    out["agreement"] = report.agreement(people, verdict).first().asDict()
    out["counts"] = report.counts(samples, scores, judgments, voted).first().asDict()
    return out
