"""Append-only logs: the last record of a key counts, and only while what it was made from is unchanged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import text_hash
from ..schema import PAIRWISE_VERSION, RUBRIC_VERSION
from ..tables import written


def succeeded(error: str = "error") -> Column:
    """An empty error is none."""
    return F.coalesce(F.col(error), F.lit("")) == ""


def last_wins(log: DataFrame, key: list[str], seq: str = "_seq") -> DataFrame:
    """The last record of each key, with _ord: where the key appeared first. One shuffle, pre-aggregated to a record for each key and task."""
    rest = [c for c in log.columns if c not in key]
    kept = log.groupBy(*key).agg(F.max_by(F.struct(*rest), seq).alias("_last"), F.min(seq).alias("_ord"))
    return kept.select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest], "_ord").select(*log.columns, "_ord")


def judgment_key() -> Column:
    """A rubric judgment is of a judge and a sample, a pairwise one of a judge, a scheme and two samples."""
    return F.when(F.col("kind") == "rubric", F.concat_ws("|", F.lit("rubric"), "judgeModel", "sampleId")).otherwise(F.concat_ws("|", F.lit("pairwise"), "judgeModel", "scheme", "aSampleId", "bSampleId"))


def persisted_ids(log: DataFrame) -> DataFrame:
    """Every id ever written, fresh or not."""
    return log.select("id").distinct()


def current_hashes(samples: DataFrame) -> DataFrame:
    """(id, hash) of samples that succeeded: a failed one's text is never what something was made from."""
    return samples.filter(succeeded()).select("id", text_hash(F.col("text")).alias("hash"))


def fresh_samples(log: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Last samples whose own provenance and whole chain of reuse still hold.

    expected: (sourceId, modelId, interventionId, expectedHash); without it own provenance is not asked about. Fresh is
    the least fixpoint: samples that reuse nothing, then those that reuse only what is fresh and unchanged, so a circle
    never is. Each round works on the edges that are still open, and an edge to a sample that waits for one other only
    then leads to that one, so that a chain of any length takes a logarithm of rounds. Of what waits without a circle
    something becomes fresh in each round, so rounds end when nothing does.
    """
    latest = last_wins(log, ["id"])
    if expected is not None:
        cell = ["sourceId", "modelId", "interventionId"]
        latest = latest.join(expected.select(*cell, "expectedHash"), cell, "left").withColumn("_own", F.coalesce(F.col("inputHash") == F.col("expectedHash"), F.lit(False))).drop("expectedHash").select(*log.columns, "_ord", "_own")
    else:
        latest = latest.withColumn("_own", F.lit(True))
    latest = written(latest)
    hashes = current_hashes(latest).withColumnsRenamed({"id": "parent", "hash": "now"})
    reuse = F.filter("steps", lambda s: (s["type"] == "generate") & (F.coalesce(s["reusedFrom"], F.lit("")) != ""))
    edges = latest.filter("_own").select("id", F.explode(reuse).alias("e")).select("id", F.col("e.reusedFrom").alias("parent"), F.col("e.reusedHash").alias("recorded"))
    edges = written(edges.join(hashes, "parent", "left").select("id", "parent", F.coalesce((F.col("recorded") != "") & (F.col("recorded") == F.col("now")), F.lit(False)).alias("holds")))
    broken = edges.filter("not holds").select("id").distinct()
    open_edges = edges.select("id", "parent").distinct()
    fresh = latest.filter("_own").select("id").join(edges.select("id").distinct(), "id", "left_anti")
    waiting = open_edges.join(broken, "id", "left_anti")
    rounds = [fresh]
    while True:
        waiting = written(waiting)
        if waiting.isEmpty():
            break
        # ids with an edge to something that is not fresh yet
        held = written(waiting.join(rounds[-1].withColumnRenamed("id", "parent"), "parent", "left_anti").select("id", "parent"))
        ready = written(waiting.select("id").distinct().join(held.select("id").distinct(), "id", "left_anti"))
        if ready.isEmpty():
            break
        rounds.append(ready)
        only = held.groupBy("id").agg(F.count("*").alias("n"), F.min("parent").alias("next")).filter("n = 1").select(F.col("id").alias("parent"), "next")
        waiting = held.join(only, "parent", "left").select("id", F.coalesce("next", "parent").alias("parent")).distinct()
    return latest.join(reduce(DataFrame.union, rounds), "id", "left_semi").select(*log.columns, "_ord")


def fresh_scores(log: DataFrame, hashes: DataFrame, scoring_hash: str | None = None) -> DataFrame:
    """Last scores of texts that are current, by the current way of scoring."""
    kept = last_wins(log, ["sampleId"]).join(hashes.select(F.col("id").alias("sampleId"), F.col("hash").alias("textHash")), ["sampleId", "textHash"], "left_semi")
    return kept if scoring_hash is None else kept.filter(F.col("scoringHash") == scoring_hash)


def fresh_judgments(log: DataFrame, hashes: DataFrame, contexts: DataFrame, judges: DataFrame) -> DataFrame:
    """Last judgments whose prompt version, texts, context and judge are current. contexts: (sourceId, contextHash); judges: (judgeModel, judgeConfigHash)."""
    kept = last_wins(log.withColumn("_key", judgment_key()), ["_key"]).drop("_key")
    kept = kept.filter(F.col("promptVersion") == F.when(F.col("kind") == "rubric", RUBRIC_VERSION).otherwise(PAIRWISE_VERSION))
    kept = kept.join(contexts, ["sourceId", "contextHash"], "left_semi").join(judges, ["judgeModel", "judgeConfigHash"], "left_semi")
    of = lambda side: hashes.select(F.col("id").alias(f"{side}SampleId"), F.col("hash").alias(f"{side}TextHash"))
    rubric = kept.filter("kind = 'rubric'").join(hashes.select(F.col("id").alias("sampleId"), F.col("hash").alias("textHash")), ["sampleId", "textHash"], "left_semi")
    pairwise = kept.filter("kind = 'pairwise'").join(of("a"), ["aSampleId", "aTextHash"], "left_semi").join(of("b"), ["bSampleId", "bTextHash"], "left_semi")
    return rubric.unionByName(pairwise)


def todo(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is not done yet, before anything expensive is run."""
    return items.join(done, key, "left_anti")


def budget(items: DataFrame, order: list[str], n: int | None) -> DataFrame:
    """The first n in order; no n is no limit."""
    return items if n is None else items.orderBy(*order).limit(n)
