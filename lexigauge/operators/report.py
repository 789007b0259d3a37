"""Aggregation of a run: metric statistics, matched comparisons, win rates, agreement.

Metrics are long rows (sampleId, key, value) and verdicts are rows (scheme, a, b, verdict), so that every table of a
report is a grouping of one of the two. Reports name models and interventions by the hundred at most; samples may be many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.compat import finite, ratio, round_half_up
from ..schema import HEADLINE, LOWER, NO_MODEL, RUBRIC_KEYS, judge_key
from .store import succeeded

CELL = ["modelId", "interventionId"]


def metric_rows(scores: DataFrame, judgments: DataFrame | None = None) -> DataFrame:
    """(sampleId, key, value): the finite metrics of scores, and the mean of each rubric score. Samples with either have rows."""
    rows = scores.select("sampleId", F.explode("metrics").alias("key", "value"))
    if judgments is not None:
        scored = judgments.filter("kind = 'rubric'")
        means = scored.groupBy("sampleId").agg(*[F.avg(f"scores.{k}").alias(judge_key(k)) for k in RUBRIC_KEYS])
        rows = rows.unionByName(means.unpivot("sampleId", [judge_key(k) for k in RUBRIC_KEYS], "key", "value"))
    return rows.filter(finite(F.col("value")))


def metric_keys(rows: DataFrame) -> DataFrame:
    """The headline keys and all that were observed."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(k,) for k in HEADLINE], "key string")
    return head.union(rows.select("key")).distinct()


def statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """(…, key, mean, sd, n): means and deviations to four places; a single value deviates by 0."""
    return rows.groupBy(*by, "key").agg(round_half_up(F.avg("value"), 4).alias("mean"), round_half_up(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("sd"), F.count("*").alias("n"))


def cell_counts(samples: DataFrame, by: list[str] = CELL) -> DataFrame:
    return samples.groupBy(*by).agg(F.count("*").alias("samples"), F.count_if(~succeeded()).alias("errors"))


def with_cells(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Metric rows of samples that succeeded, with the samples' cells."""
    return rows.join(samples.filter(succeeded()).select(F.col("id").alias("sampleId"), "sourceId", "sampleIndex", *CELL), "sampleId")


def cell_statistics(rows: DataFrame, samples: DataFrame) -> DataFrame:
    return statistics(with_cells(rows, samples), CELL)


def rollup_statistics(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """For each cell and, as model "*", for each intervention over its samples, from one pass over the rows."""
    grouped = with_cells(rows, samples).groupingSets([["modelId", "interventionId", "key"], ["interventionId", "key"]], "modelId", "interventionId", "key").agg(
        round_half_up(F.avg("value"), 4).alias("mean"), round_half_up(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("sd"), F.count("*").alias("n"), F.grouping("modelId").alias("g")
    )
    return grouped.withColumn("modelId", F.when(F.col("g") == 1, F.lit("*")).otherwise(F.col("modelId"))).drop("g")


def model_table(samples: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Samples and errors of each model's baseline; a model all of whose samples failed is listed."""
    return cell_counts(samples.filter((F.col("modelId") != NO_MODEL) & (F.col("interventionId") == baseline)), ["modelId"])


def improvement(base: Column, new: Column, key: Column) -> Column:
    """Per cent by which a metric got better, to one place. Metrics without a direction count as better when higher. From 0 only staying at 0 has a value."""
    better = F.when(key.isin(*LOWER), base - new).otherwise(new - base)
    return F.when(base == 0, F.when(new == 0, F.lit(0.0))).otherwise(round_half_up(ratio(better, F.abs(base)) * 100.0, 1))


def baseline_pairs(samples: DataFrame, baseline: str = "baseline") -> DataFrame:
    """(id, baseId, …): each other sample that succeeded with the baseline sample of its source, model and index, else of the source and index without a model."""
    ok = samples.filter(succeeded())
    base = ok.filter(F.col("interventionId") == baseline)
    same = base.select("sourceId", "modelId", "sampleIndex", F.col("id").alias("sameId"))
    bare = base.filter(F.col("modelId") == NO_MODEL).select("sourceId", "sampleIndex", F.col("id").alias("bareId"))
    next_ = ok.filter(F.col("interventionId") != baseline)
    found = next_.join(same, ["sourceId", "modelId", "sampleIndex"], "left").join(bare, ["sourceId", "sampleIndex"], "left")
    return found.withColumn("baseId", F.coalesce("sameId", "bareId")).filter("baseId is not null and baseId <> id").select("id", "baseId", "sourceId", "sampleIndex", *CELL)


def matched_comparison(rows: DataFrame, samples: DataFrame, baseline: str = "baseline", by: list[str] | None = None) -> DataFrame:
    """(…, key, delta, improvementPct, matchedN, matched): what changed against the matched baseline, over pairs with both values.

    The percentage comes from means that are not rounded; matched counts all pairs of a group, values or not.
    """
    by = by or CELL
    pairs = baseline_pairs(samples, baseline)
    both = pairs.join(rows.select(F.col("sampleId").alias("id"), "key", F.col("value").alias("new")), "id").join(rows.select(F.col("sampleId").alias("baseId"), "key", F.col("value").alias("base")), ["baseId", "key"])
    means = both.groupBy(*by, "key").agg(F.avg("new").alias("n"), F.avg("base").alias("b"), F.count("*").alias("matchedN"))
    changed = means.select(*by, "key", round_half_up(F.col("n") - F.col("b"), 4).alias("delta"), improvement(F.col("b"), F.col("n"), F.col("key")).alias("improvementPct"), "matchedN")
    return changed.join(pairs.groupBy(*by).agg(F.count("*").alias("matched")), by)


def flip(verdict: Column) -> Column:
    return F.when(verdict == "A", "B").when(verdict == "B", "A").otherwise("tie")


def combine(ab: Column, ba: Column) -> Column:
    """One verdict of both orders: a tie unless they agree. ba is already turned round."""
    return F.when(ab == ba, ab).otherwise("tie")


def win_rate(verdicts: DataFrame, by: list[str], verdict: str = "verdict") -> DataFrame:
    """(…, wins, losses, ties, n, rate): A wins; a tie is half a win."""
    v = F.col(verdict)
    counted = verdicts.groupBy(*by).agg(F.count_if(v == "A").alias("wins"), F.count_if(v == "B").alias("losses"), F.count_if(~v.isin("A", "B")).alias("ties"))
    return with_rate(counted)


def with_rate(counted: DataFrame) -> DataFrame:
    n = F.col("wins") + F.col("losses") + F.col("ties")
    return counted.withColumn("n", n).withColumn("rate", round_half_up(ratio(F.col("wins") + F.col("ties") * 0.5, F.col("n")), 3))


def merge_wins(cells: DataFrame, by: list[str]) -> DataFrame:
    """Win tables summed over cells."""
    return with_rate(cells.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("wins", "losses", "ties")]))


def intervention_wins(verdicts: DataFrame, samples: DataFrame, baseline: str = "baseline") -> DataFrame:
    """What each cell wins against the baseline, where B of a pair is a baseline sample."""
    cells = samples.select(F.col("id").alias("a"), *CELL)
    base = samples.filter(F.col("interventionId") == baseline).select(F.col("id").alias("b"))
    return win_rate(verdicts.filter("scheme = 'interventions'").join(base, "b", "left_semi").join(cells, "a"), CELL)


def model_wins(verdicts: DataFrame, samples: DataFrame, baseline: str = "baseline") -> DataFrame:
    """What each model wins against the others; a pair counts for both of its models."""
    base = samples.filter(F.col("interventionId") == baseline)
    both = verdicts.filter("scheme = 'models'").join(base.select(F.col("id").alias("a"), F.col("modelId").alias("ma")), "a").join(base.select(F.col("id").alias("b"), F.col("modelId").alias("mb")), "b")
    sides = both.select(F.explode(F.array(F.struct(F.col("ma").alias("modelId"), F.col("verdict").alias("verdict")), F.struct(F.col("mb").alias("modelId"), flip(F.col("verdict")).alias("verdict")))).alias("s")).select("s.*")
    return win_rate(sides, ["modelId"])


def majority(a: Column, b: Column, tie: Column) -> Column:
    """The verdict with more votes than each other one, else a tie."""
    return F.when((a > b) & (a > tie), "A").when((b > a) & (b > tie), "B").otherwise("tie")


def majority_votes(votes: DataFrame, by: list[str]) -> DataFrame:
    c = F.col("choice")
    counted = votes.groupBy(*by).agg(F.count("*").alias("votes"), F.count_if(c == "A").alias("a"), F.count_if(c == "B").alias("b"), F.count_if(c == "tie").alias("tie"))
    return counted.withColumn("verdict", majority(F.col("a"), F.col("b"), F.col("tie")))


def agreement(human: DataFrame, judged: DataFrame) -> DataFrame:
    """One row (n, agree, rate) over pairs (a, b) with a human and a judge's verdict, whatever their scheme."""
    both = human.select("a", "b", F.col("verdict").alias("h")).join(judged.select("a", "b", F.col("verdict").alias("j")), ["a", "b"])
    counted = both.agg(F.count("*").alias("n"), F.count_if(F.col("h") == F.col("j")).alias("agree"))
    return counted.withColumn("rate", round_half_up(ratio(F.col("agree"), F.col("n")), 3))


def rule_totals(scores: DataFrame) -> DataFrame:
    return scores.select("interventionId", F.explode("textlintRules").alias("rule", "n")).groupBy("interventionId", "rule").agg(F.sum("n").alias("total"))


def rule_matrix(totals: DataFrame, interventions: list[str]) -> DataFrame:
    """Rules by interventions; what a rule never found is 0."""
    return totals.groupBy("rule").pivot("interventionId", interventions).agg(F.sum("total")).fillna(0)


def wide(stats: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Statistics as a table with a column for each metric's mean."""
    return stats.groupBy(*by).pivot("key", keys).agg(F.first("mean"))


def check_baseline(chosen: str, interventions: list[dict]) -> str:
    """chosen if there is such an intervention: a misspelt baseline would give an empty report."""
    known = [i["id"] for i in interventions]
    if chosen not in known:
        raise ValueError(f"no intervention {chosen!r} to be the baseline; there are: {', '.join(known)}")
    return chosen


def judge_of(judgments: DataFrame, chosen: str | None = None) -> str | None:
    """The judge whose verdicts a report has: the one asked for, else the first by name."""
    judges = sorted(r[0] for r in judgments.select("judgeModel").distinct().collect())  # a name for each judge
    if chosen is not None and chosen not in judges:
        raise ValueError(f"no judgments by {chosen!r}; there are: {', '.join(judges)}")
    return chosen or next(iter(judges), None)


def counts(samples: DataFrame, scores: DataFrame, judgments: DataFrame, votes: DataFrame) -> DataFrame:
    """One row: how many there are of everything."""
    one = lambda df, *cols: df.agg(*cols)
    return (
        one(samples, F.count("*").alias("samples"), F.count_if(~succeeded()).alias("errors"))
        .join(one(scores, F.count("*").alias("scores")))
        .join(one(judgments, F.count_if(F.col("kind") == "rubric").alias("rubric"), F.count_if(F.col("kind") == "pairwise").alias("pairwise")))
        .join(one(votes, F.count("*").alias("humanVotes")))
    )


def rank_order(df: DataFrame, *cols: str) -> DataFrame:
    """In locale order, as cells are listed."""
    return df.orderBy(*[F.collate(F.col(c), "UNICODE") for c in cols])


def ranks(spark: SparkSession, names: list[str]) -> dict[str, int]:
    """Names of a report with their places in locale order."""
    rows = rank_order(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect() if names else []
    return {r["name"]: k for k, r in enumerate(rows)}
