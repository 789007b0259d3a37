"""Pairs of samples to compare, for judges and for people."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import hashed, permutation
from ..schema import DEFAULT_AUDIENCE, NO_MODEL
from ..tables import written
from .report import baseline_pairs
from .store import succeeded


def usable(samples: DataFrame) -> DataFrame:
    """Samples that succeeded and have a text."""
    return samples.filter(succeeded() & (F.coalesce(F.col("text"), F.lit("")) != ""))


def intervention_pairs(samples: DataFrame, baseline: str = "baseline") -> DataFrame:
    """(scheme, sourceId, a, b): a sample of another intervention, and its baseline."""
    return baseline_pairs(usable(samples), baseline).select(F.lit("interventions").alias("scheme"), "sourceId", F.col("id").alias("a"), F.col("baseId").alias("b"))


def model_pairs(samples: DataFrame, baseline: str = "baseline") -> DataFrame:
    """(scheme, sourceId, a, b): baseline samples of two models for one source and index; a's model is first in locale order.

    The result is all pairs of a group by its meaning; a group has a sample for each model.
    """
    base = usable(samples).filter((F.col("interventionId") == baseline) & (F.col("modelId") != NO_MODEL))
    rank = F.row_number().over(Window.partitionBy("sourceId", "sampleIndex").orderBy(F.collate(F.col("modelId"), "UNICODE"), "id"))
    ranked = base.select("sourceId", "sampleIndex", "modelId", "id", rank.alias("r"))
    right = ranked.select("sourceId", "sampleIndex", F.col("id").alias("b"), F.col("r").alias("rb"), F.col("modelId").alias("mb"))
    both = ranked.join(right, ["sourceId", "sampleIndex"]).filter("r < rb and modelId <> mb")
    return both.select(F.lit("models").alias("scheme"), "sourceId", F.col("id").alias("a"), "b")


def scheme_pairs(samples: DataFrame, schemes: list[str], baseline: str = "baseline") -> DataFrame:
    made = [{"interventions": intervention_pairs, "models": model_pairs}[s](samples, baseline) for s in schemes]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def human_pairs(samples: DataFrame, sources: DataFrame, schemes: list[str], seed: int = 42, most: int | None = None, baseline: str = "baseline") -> DataFrame:
    """Pairs as people see them, in a seeded order, at most `most`. sources: (id, title, audience).

    The order is a sequence of swaps of places, which needs the number of pairs only; pairs get their places by a range
    sort, without their ids or texts on the driver. Texts are joined to the pairs that are shown.
    """
    spark = samples.sparkSession
    texts = lambda side: samples.select(F.col("id").alias(side), F.col("text").alias(f"{side}Text"))
    info = sources.select(F.col("id").alias("sourceId"), "title", "audience")
    by = ["scheme", "a", "b"]
    found = scheme_pairs(samples, schemes, baseline).repartitionByRange(*by).sortWithinPartitions(*by)
    found = written(found.withColumns({"_part": F.spark_partition_id(), "_line": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = sorted((r["_part"], r["count"]) for r in found.groupBy("_part").count().collect())  # a row for each task
    begins = [(part, sum(n for _, n in sizes[:k])) for k, (part, _) in enumerate(sizes)]
    order = permutation(sum(n for _, n in sizes), seed)[: most or None]
    places = spark.createDataFrame([(k, n) for n, k in enumerate(order)], "_place bigint, _ord bigint")
    shown = found.join(F.broadcast(spark.createDataFrame(begins, "_part int, _begin bigint")), "_part").withColumn("_place", F.col("_begin") + F.col("_line")).join(places, "_place")
    pairs = shown.join(texts("a"), "a").join(texts("b"), "b").join(info, "sourceId", "left")
    title, audience = F.coalesce("title", "sourceId"), F.coalesce("audience", F.lit(DEFAULT_AUDIENCE))
    key = F.left(hashed(F.col("scheme"), F.col("a"), F.col("b"), F.col("aText"), F.col("bText"), title, audience), F.lit(16))
    return pairs.select(key.alias("id"), "sourceId", "scheme", F.col("a").alias("aSampleId"), F.col("b").alias("bSampleId"), "aText", "bText", title.alias("taskTitle"), audience.alias("audience"), "_ord").orderBy("_ord")


def current_pairs(pairs: DataFrame, samples: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs whose samples still succeed with the texts shown, under the title and audience shown. Texts meet by their hashes."""
    now = lambda side: samples.filter(succeeded()).select(F.col("id").alias(f"{side}SampleId"), F.sha2("text", 256).alias(f"_{side}"))
    info = sources.select(F.col("id").alias("sourceId"), F.col("title").alias("_t"), F.col("audience").alias("_a"))
    marked = pairs.withColumns({"_a": F.sha2("aText", 256), "_b": F.sha2("bText", 256)})
    kept = marked.join(now("a"), ["aSampleId", "_a"], "left_semi").join(now("b"), ["bSampleId", "_b"], "left_semi").drop("_a", "_b").join(info, "sourceId")
    same = (F.col("taskTitle") == F.coalesce("_t", "sourceId")) & (F.coalesce("audience", F.lit(DEFAULT_AUDIENCE)) == F.coalesce("_a", F.lit(DEFAULT_AUDIENCE)))
    return kept.filter(same).select(*pairs.columns)
