"""Reports as Markdown, from collected tables of a report's size."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from typing import Any

from ..schema import HEADLINE, RUBRIC_KEYS, judge_key

#: Metrics shown in per cent.
PERCENT = ("longSentenceRatio", "veryLongSentenceRatio", "manyTenRatio", "kanjiRatio", "hiraganaRatio", "katakanaRatio", "latinRatio", "kangoRatio", "wagoRatio", "verbRatio", "particleRatio")


def fixed(x: float, digits: int) -> str:
    """The exact binary value, half-way values away from zero."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def number(key: str, x: float | None) -> str:
    if x is None:
        return "–"
    return f"{fixed(x * 100, 1)}%" if key in PERCENT else fixed(x, 2)


def stat(key: str, mean: float | None, n: int | None = None, samples: int | None = None) -> str:
    """A mean, with how many values it is of where some samples have none."""
    return number(key, mean) + (f" [n={n}]" if n is not None and samples is not None and n != samples else "")


def percent(x: float | None, delta: float | None = None, matched_n: int | None = None, matched: int | None = None) -> str:
    """An improvement; from a base of 0 the difference; with how many pairs where not all have the metric."""
    if x is None and delta is None:
        return "–"
    shown = f"({'+' if delta >= 0 else ''}{fixed(delta, 2)}, 基準 0)" if x is None else f"{'+' if x > 0 else ''}{fixed(x, 1)}%"
    return shown + (f" (対 {matched_n} 件)" if matched_n is not None and matched is not None and matched_n != matched else "")


def wins(w: dict[str, Any] | None) -> str:
    return "–" if not w or not w["n"] else f"{fixed(w['rate'] * 100, 1)}% ({w['wins']}-{w['losses']}-{w['ties']})"


def grid(head: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def columns(keys: set[str]) -> list[str]:
    """Headline metrics, then the judges' that there are."""
    return [*HEADLINE, *(k for k in map(judge_key, RUBRIC_KEYS) if k in keys)]


def markdown(report: dict[str, Any]) -> str:
    """report: models, cells, interventions (lists of rows with stats {key: {mean, n}} and changes {key: {pct, delta, matchedN, matched}}), ruleCounts {rule: {intervention: n}}, agreement, counts."""
    keys = {k for part in ("models", "cells", "interventions") for row in report.get(part, []) for k in row["stats"]}
    cols = columns(keys)
    title = lambda row, *names: [str(row[n]) for n in names]

    def table(rows: list[dict], *names: str) -> str:
        out = []
        for r in rows:
            cells = []
            for k in cols:
                s, c = r["stats"].get(k), r.get("changes", {}).get(k)
                text = stat(k, s["mean"], s["n"], r["samples"] - r["errors"]) if s else "–"
                cells.append(text + (f" {percent(c['pct'], c['delta'], c['matchedN'], c['matched'])}" if c else ""))
            out.append([*title(r, *names), f"{r['samples']}" + (f" ({r['errors']} failed)" if r["errors"] else ""), *cells, wins(r.get("judge")), wins(r.get("human"))])
        return grid([*names, "samples", *cols, "judge", "human"], out)

    parts = ["# Report"]
    if report.get("models"):
        parts += ["## Models", table(report["models"], "modelId")]
    if report.get("interventions"):
        parts += ["## Interventions", table(report["interventions"], "interventionId")]
        parts += ["## Cells", table(report["cells"], "modelId", "interventionId")]
    if report.get("ruleCounts"):
        names = sorted({i for row in report["ruleCounts"].values() for i in row})
        parts += ["## Rules", grid(["rule", *names], [[r.rsplit("/", 1)[-1], *(str(row.get(n, 0)) for n in names)] for r, row in sorted(report["ruleCounts"].items())])]
    if report.get("agreement") and report["agreement"]["n"]:
        a = report["agreement"]
        parts += ["## Agreement", f"People and the judge agree on {a['agree']} of {a['n']} pairs ({fixed(a['rate'] * 100, 1)}%)."]
    return "\n\n".join(parts) + "\n"
