"""Which samples of a run are to be made, and in which order: the reuse graph and incremental plans.

Interventions are a handful, so their graph is walked on the driver; sources and samples are tables, so jobs are joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NO_MODEL

JOB = ["sourceId", "modelId", "interventionId", "sampleIndex"]


def reused(intervention: dict) -> list[str]:
    """What an intervention takes over, in order, each once."""
    return list(dict.fromkeys(s["reuse"] for s in intervention["steps"] if s["type"] == "generate" and s.get("reuse")))


def dependents(of: str, interventions: list[dict]) -> list[str]:
    """Everything that takes over `of`, directly or not, nearest first."""
    found: dict[str, None] = {}
    front = [of]
    while front:
        front = [i["id"] for i in interventions if i["id"] not in found and i["id"] != of and any(r in front for r in reused(i))]
        found |= dict.fromkeys(front)
    return list(found)


def levels(chosen: list[str], interventions: list[dict]) -> list[list[str]]:
    """Chosen interventions by the longest way to what they take over. What is not chosen counts as made one level earlier; a circle is an error."""
    by_id = {i["id"]: i for i in interventions}
    level: dict[str, int] = {}
    on_way: set[str] = set()

    def of(name: str) -> int:
        if name not in by_id:
            return 0
        if name in on_way:
            raise ValueError(f"interventions take each other over in a circle: {name}")
        if name not in level:
            on_way.add(name)
            level[name] = max((of(r) + 1 for r in reused(by_id[name])), default=0)
            on_way.discard(name)
        return level[name]

    placed = [(of(c), c) for c in chosen]
    return [[c for n, c in placed if n == k] for k in range(max((n for n, _ in placed), default=-1) + 1)]


def needs_model(intervention: dict, interventions: list[dict]) -> bool:
    """Whether a given text goes through a model: a rewriting step without a model of its own, or taking over something that does."""
    by_id = {i["id"]: i for i in interventions}
    seen: set[str] = set()
    front = [intervention]
    while front:
        one = front.pop()
        if one["id"] in seen:
            continue
        seen.add(one["id"])
        if any(s["type"] == "rewrite" and not s.get("model") for s in one["steps"]):
            return True
        front += [by_id[r] for r in reused(one) if r in by_id]
    return False


def sample_id(*cell: str):
    source, model, intervention, index = cell or JOB
    return F.concat_ws("__", source, model, intervention, F.col(index).cast("string"))


def cell_id():
    return F.concat_ws("__", *JOB[:3])


def matrix(sources: DataFrame, choices: DataFrame, per_cell: int) -> DataFrame:
    """Jobs of sources (sourceId, sourceType) and choices (sourceType, modelId, interventionId): every combination, per_cell times. choices has a row for each pair of model and intervention, so the product is as large as its meaning."""
    return sources.join(choices, "sourceType").select("sourceId", "sourceType", "modelId", "interventionId", F.explode(F.sequence(F.lit(0), F.lit(per_cell - 1))).alias("sampleIndex"))


def choices(spark: SparkSession, selected: list[dict], models: list[str], interventions: list[dict]) -> DataFrame:
    """(sourceType, modelId, interventionId): tasks go to each model, given texts only where a model is needed."""
    rows = [("task", m, i["id"]) for i in selected for m in models]
    for i in selected:
        rows += [("corpus", m, i["id"]) for m in (models if needs_model(i, interventions) else [NO_MODEL])]
    return spark.createDataFrame(rows, "sourceType string, modelId string, interventionId string")


@dataclass
class Plan:
    jobs: DataFrame
    cells: DataFrame
    skipped: int


def plan_jobs(sources: DataFrame, selected: list[dict], models: list[str], interventions: list[dict], fresh: DataFrame, persisted: DataFrame, per_cell: int = 1, force: bool = False) -> Plan:
    """Jobs not made yet, with what they take over. fresh, persisted: (id).

    With force, selected jobs are made again, and so are their dependents that were ever made; what is taken over is
    made only where it is not fresh, force or not.
    """
    spark = sources.sparkSession
    by_id = {i["id"]: i for i in interventions}
    jobs = matrix(sources, choices(spark, selected, models, interventions), per_cell).withColumn("id", sample_id())
    if force:
        again = {d for i in selected for d in dependents(i["id"], interventions)}
        if again:
            rows = [("task", m, i, d) for s in selected for i in [s["id"]] for d in dependents(i, interventions) for m in models]
            rows += [("corpus", m, s["id"], d) for s in selected for d in dependents(s["id"], interventions) for m in [NO_MODEL, *models]]
            more = spark.createDataFrame(list(dict.fromkeys((t, m, d) for t, m, _, d in rows)), "sourceType string, modelId string, interventionId string")
            jobs = jobs.unionByName(matrix(sources, more, per_cell).withColumn("id", sample_id()).join(persisted.select("id").distinct(), "id", "left_semi").select(*jobs.columns)).dropDuplicates(["id"])
    touched = jobs
    made = jobs if force else jobs.join(fresh.select("id"), "id", "left_anti").select(*jobs.columns)
    all_jobs, front = made, made
    # one round for each step of the longest chain of reuse
    for _ in range(len(interventions)):
        edges = [(i["id"], r, needs_model(by_id[r], interventions)) for i in interventions for r in reused(i) if r in by_id]
        if not edges:
            break
        uses = spark.createDataFrame(edges, "interventionId string, reuse string, asks boolean")
        model = F.when((F.col("sourceType") == "corpus") & ~F.col("asks"), NO_MODEL).otherwise(F.col("modelId"))
        need = front.join(uses, "interventionId").select("sourceId", "sourceType", model.alias("modelId"), F.col("reuse").alias("interventionId"), "sampleIndex").withColumn("id", sample_id()).dropDuplicates(["id"])
        touched = touched.unionByName(need.select(*jobs.columns))
        front = need.select(*jobs.columns).join(fresh.select("id"), "id", "left_anti").join(all_jobs.select("id"), "id", "left_anti").select(*jobs.columns)
        all_jobs = all_jobs.unionByName(front)
        if not any(reused(by_id[r]) for _, r, _ in edges):
            break
    cells = touched.select(cell_id().alias("cell")).distinct()
    return Plan(all_jobs.dropDuplicates(["id"]), cells, 0 if force else fresh.count())


def extra_samples(ids: DataFrame, cells: DataFrame, per_cell: int) -> DataFrame:
    """Ids of touched cells whose index is at least per_cell. An id is read from its end; one without an index part is none."""
    pattern = r"(?s)^(.*)__(\d*)$"
    rows = ids.filter(F.col("id").rlike(pattern)).select("id", F.regexp_extract("id", pattern, 1).alias("cell"), F.regexp_extract("id", pattern, 2).alias("n"))
    index = F.when(F.col("n") == "", 0).otherwise(F.expr("try_cast(n as bigint)"))
    return rows.filter(index >= per_cell).join(cells, "cell", "left_semi").select("id")
