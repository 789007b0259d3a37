"""Commands over run folders: list, run, score, judge, report, pairs, serve, human-report, show."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import lint, text, tokens
from .operators import full_report, human, judge, pairs, render, report, store
from .plans import pipeline, planning
from .session import local_session
from .sources import definitions, logs, providers, serve
from .tables import written


def scoring_hash(tokenizer: str = tokens.TOKENIZER) -> str:
    """What scores depend on besides texts: the metrics' version, the lint rules, the tokenizer."""
    return hashlib.sha256("\x1f".join([schema.METRICS_VERSION, lint.rules_version(), tokenizer]).encode()).hexdigest()


def scored(samples: DataFrame, version: str) -> DataFrame:
    """Scores of samples: surface metrics, those of tokens, and lint."""
    wide = text.with_surface(samples.select(F.col("id").alias("sampleId"), "sourceId", "modelId", "interventionId", "text"))
    by_token = tokens.token_metrics(tokens.token_rows(wide), wide.select("sampleId", "sentences", "meanSentenceLength"))
    keys = [c for c in by_token.columns if c != "sampleId"]
    wide = lint.with_lint(wide.join(by_token, "sampleId"), "text", "textlintMessages")
    found = F.col("textlintMessages")
    extra = {"textlintCount": F.size(found).cast("double"), "textlintPer1k": F.size(found) / F.greatest("chars", F.lit(1)).cast("double") * 1000.0, "textlintFixable": lint.fixable(found).cast("double")}
    all_keys = [*text.SURFACE, *keys, *extra]
    wide = wide.withColumns(extra)
    metrics = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, all_keys)), F.array(*[F.col(k).cast("double") for k in all_keys])), lambda k, v: v.isNotNull() & ~F.isnan(v))
    return wide.select("sampleId", F.sha2("text", 256).alias("textHash"), F.lit(version).alias("scoringHash"), "sourceId", "modelId", "interventionId", metrics.alias("metrics"), lint.rule_counts(found).alias("textlintRules"), "textlintMessages")


class Bench:
    """The definitions of a folder and the logs of one of its runs."""

    def __init__(self, args: argparse.Namespace, spark: SparkSession):
        self.args, self.spark = args, spark
        self.sources, self.config, self.interventions = load(args.dir)
        self.models = {m["id"]: m for m in self.config["models"]}
        self.at = logs.run_files(f"{args.dir}/results/runs", args.run)
        self.rows = definitions.source_rows(spark, self.sources)
        folder = f"{args.dir}/fixtures/mock"
        self.fixtures = logs.read_fixtures(spark, folder) if Path(folder).is_dir() else None
        contents = {p.stem: p.read_text("utf-8") for p in definitions.files(folder, ".md")}
        self.expected = pipeline.expected_hashes(self.rows, self.interventions, self.config["models"], lint.rules_version(), contents)
        if args.command != "run" and not logs.exists(spark, self.at["samples"]):
            raise SystemExit(f"the run {args.run!r} has no samples; run it first")
        self.log = self.read("samples", schema.SAMPLES)
        self.fresh = store.fresh_samples(self.log, self.expected)
        self.info = self.rows.select(F.col("id").alias("sourceId"), "title", "audience")

    def read(self, name: str, ddl: str) -> DataFrame:
        return logs.read_log(self.spark, self.at[name], ddl)

    def append(self, name: str, ddl: str, made: DataFrame, *order: str) -> None:
        logs.append_log(logs.numbered(made, logs.next_seq(self.read(name, ddl)), *order), self.at[name])

    def baseline(self) -> str:
        return report.check_baseline(self.args.baseline, self.interventions)

    def scores(self) -> DataFrame:
        return store.fresh_scores(self.read("scores", schema.SCORES), store.current_hashes(self.fresh), scoring_hash())

    def judgments(self) -> DataFrame:
        contexts = self.info.select("sourceId", judge.context_hash(F.coalesce("title", "sourceId"), F.col("audience")).alias("contextHash"))
        judges = self.spark.createDataFrame([(i, judge.config_hash(m)) for i, m in self.models.items()], "judgeModel string, judgeConfigHash string")
        return store.fresh_judgments(self.read("judgments", schema.JUDGMENTS), store.current_hashes(self.fresh), contexts, judges)

    def shown_pairs(self) -> DataFrame:
        return pairs.current_pairs(logs.read_snapshot(self.spark, self.at["pairs"], schema.PAIRS), self.fresh, self.rows.select("id", "title", "audience"))

    def votes(self) -> DataFrame:
        return store.last_wins(self.read("votes", schema.VOTES), ["raterId", "pairId"]).drop("_ord")

    # commands

    def run(self) -> None:
        args = self.args
        chosen = definitions.pick(self.interventions, definitions.parse_list(args.interventions), "intervention")
        models = [m["id"] for m in definitions.pick(self.config["models"], definitions.parse_list(args.models), "model")]
        kind, ids = ("corpus", args.corpus or None) if args.corpus is not None else ("task", args.tasks)
        picked = [s["id"] for s in definitions.pick([s for s in self.sources if s["sourceType"] == kind], definitions.parse_list(ids), kind)]
        some = self.rows.filter(F.col("id").isin(picked)).select(F.col("id").alias("sourceId"), "sourceType")
        count = definitions.parse_count(args.samples)
        ids = self.fresh.filter(store.succeeded()).select("id")
        plan = planning.plan_jobs(some, chosen, models, self.interventions, ids, store.persisted_ids(self.log), count, args.force)
        extra = [r[0] for r in planning.extra_samples(store.persisted_ids(self.log), plan.cells, count).take(5)]
        if extra:
            raise SystemExit(f"the run has more samples than asked for: {', '.join(extra)}")
        made = pipeline.run(plan, self.rows, self.fresh.filter(store.succeeded()), self.interventions, self.config["models"], self.fixtures, definitions.parse_count(args.concurrency or 4))
        if made is None:
            return
        made = made.join(self.expected, ["sourceId", "modelId", "interventionId"]).withColumn("inputHash", F.col("expectedHash")).drop("expectedHash").withColumn("runId", F.lit(args.run)).withColumn("createdAt", judge.created())
        made = written(made)
        self.append("samples", schema.SAMPLES, made, "id")
        for r in made.filter(~store.succeeded()).select("id", "error").orderBy("id").toLocalIterator():
            print(f"error: {r['id']}: {r['error']}", file=sys.stderr)

    def score(self) -> None:
        done = self.read("scores", schema.SCORES).limit(0) if self.args.force else self.scores()
        todo = store.todo(pairs.usable(self.fresh), done.select(F.col("sampleId").alias("id")), ["id"])
        self.append("scores", schema.SCORES, scored(todo, scoring_hash()), "sampleId")

    def judge(self) -> None:
        """Asks the judge; what fails is reported and stays undone. Answers are kept in results/cache/judge, whatever the run."""
        args, spark = self.args, self.spark
        baseline, schemes = self.baseline(), definitions.parse_schemes(args.schemes)
        model = definitions.pick(self.config["models"], [args.judge or self.config["judge"]["model"]], "model")[0]
        if model.get("fallbacks"):
            raise SystemExit(f"{model['id']} may hand requests to another model, so it cannot be a judge")
        providers.provider_for(model)  # a missing key ends it here
        config, name, parallel = judge.config_hash(model), model["id"], definitions.parse_count(args.concurrency or 3)
        limit = definitions.parse_count(args.limit, 0) if args.limit is not None else None
        done = self.judgments().filter(F.col("judgeModel") == name)
        ok = pairs.usable(self.fresh)
        folder = f"{args.dir}/results/cache/judge"
        if args.mode in ("both", "rubric"):
            items = ok.select(F.col("id").alias("sampleId"), "sourceId", "text", "_ord")
            todo = written(store.budget(store.todo(items, done.filter("kind = 'rubric'").select("sampleId"), ["sampleId"]), ["_ord"], limit).drop("_ord"))
            limit = None if limit is None else limit - todo.count()
            made, new = judge.judge_rubric(todo, self.info, name, config, judge.rubric_answers(model, parallel), self.cache(folder, "rubric", judge.RUBRIC_ANSWER), not args.no_cache)
            self.keep(made, new, folder, "rubric", "sampleId")
        if args.mode in ("both", "pairwise"):
            both = pairs.scheme_pairs(self.fresh, schemes, baseline)
            todo = store.todo(both, done.filter("kind = 'pairwise'").select("scheme", F.col("aSampleId").alias("a"), F.col("bSampleId").alias("b")), ["scheme", "a", "b"])
            todo = store.budget(todo, ["scheme", "a", "b"], limit)
            side = lambda s: ok.select(F.col("id").alias(s), F.col("text").alias(f"{s}Text"))
            made, new = judge.judge_pairwise(todo.join(side("a"), "a").join(side("b"), "b"), self.info, name, config, judge.pairwise_answers(model, parallel), self.cache(folder, "pairwise", judge.PAIRWISE_ANSWER), not args.no_cache)
            self.keep(made, new, folder, "pairwise", "scheme", "aSampleId", "bSampleId")

    def cache(self, folder: str, kind: str, ddl: str) -> DataFrame | None:
        """Answers of earlier runs, an answer for each key."""
        path = f"{folder}/{kind}"
        return None if self.args.no_cache or not logs.exists(self.spark, path) else self.spark.read.schema(ddl).option("mode", "FAILFAST").json(path).dropDuplicates(["cacheKey"])

    def keep(self, made: DataFrame, new: DataFrame, folder: str, kind: str, *order: str) -> None:
        made = written(made)
        if not self.args.no_cache:
            logs.append_log(new.filter("error is null").drop("error"), f"{folder}/{kind}")
        self.append("judgments", schema.JUDGMENTS, made.filter("error is null").drop("error"), *order)
        for r in made.filter("error is not null").select("error", *order).toLocalIterator():
            print("error:", *[r[c] for c in order], r["error"], file=sys.stderr)

    def report(self) -> None:
        baseline = self.baseline()
        out = full_report.build(self.fresh, self.scores(), self.judgments(), self.votes(), self.shown_pairs(), baseline, self.args.judge)
        logs.write_text(self.spark, self.at["report"], json.dumps(out, ensure_ascii=False, indent=1))
        logs.write_text(self.spark, self.at["markdown"], render.markdown(out))

    def pairs(self) -> None:
        limit = definitions.parse_count(self.args.limit) if self.args.limit is not None else None
        made = pairs.human_pairs(self.fresh, self.rows.select("id", "title", "audience"), definitions.parse_schemes(self.args.schemes), definitions.parse_count(self.args.seed, 0), limit, self.baseline())
        logs.write_snapshot(made.drop("_ord").coalesce(1), self.at["pairs"])

    def vote_server(self):
        """A server of the run's current pairs on this machine."""
        shown = [r.asDict() for r in self.shown_pairs().collect()]  # pairs that people vote on
        if not shown:
            raise SystemExit(f"the run {self.args.run!r} has no current pairs; make them first")
        per_rater = definitions.parse_count(self.args.per_rater) if self.args.per_rater is not None else None
        votes = serve.Votes(shown, [r.asDict() for r in self.votes().select("pairId", "raterId").collect()], self.at["votes"], per_rater)
        return serve.server(votes, definitions.parse_count(self.args.port, 0))

    def serve(self) -> None:
        at = self.vote_server()
        print(f"http://localhost:{at.server_port}/", file=sys.stderr)
        at.serve_forever()

    def human_report(self) -> None:
        if not logs.exists(self.spark, self.at["pairs"]):
            raise SystemExit(f"the run {self.args.run!r} has no pairs; make them first")
        shown = self.shown_pairs()
        on = human.on_pairs(self.votes(), shown)
        out = human.summary(on).first().asDict() | {"shown": shown.count(), "perPair": [r.asDict() for r in human.tallies(on).collect()]}
        logs.write_text(self.spark, self.at["humanReport"], json.dumps(out, ensure_ascii=False, indent=1))
        print(json.dumps(out, ensure_ascii=False, indent=1))

    def show(self) -> None:
        found = self.fresh.filter(F.col("id") == self.args.sample).first()
        if found is None:
            raise SystemExit(f"no sample {self.args.sample!r}")
        if found["inputText"]:
            print("before:", found["inputText"], sep="\n")
        print(found["text"])
        for r in self.scores().filter(F.col("sampleId") == self.args.sample).collect():
            print(json.dumps(r["metrics"], ensure_ascii=False, indent=1), *(f"{m['line']}:{m['column']} {m['ruleId']}: {m['message']}" for m in r["textlintMessages"] or ()), sep="\n")
        for r in self.judgments().filter((F.col("kind") == "rubric") & (F.col("sampleId") == self.args.sample)).collect():
            print(r["judgeModel"], json.dumps(r["scores"].asDict(), ensure_ascii=False), r["rationale"], sep="\n")


def load(folder: str):
    tasks, corpus = definitions.load_tasks(f"{folder}/tasks"), definitions.load_corpus(f"{folder}/corpus")
    models = definitions.load_models(f"{folder}/config/models.yaml")
    return definitions.load_sources(tasks, corpus), models, definitions.load_interventions(f"{folder}/interventions", models["models"])


COMMANDS = ["list", "run", "score", "judge", "report", "pairs", "serve", "human-report", "show"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexigauge")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--dir", default=".")
    p.add_argument("--run", default="default")
    for name in ("--tasks", "--models", "--interventions", "--schemes", "--sample", "--judge", "--limit", "--concurrency", "--per-rater"):
        p.add_argument(name)
    p.add_argument("--corpus", nargs="?", const="", help="run over given texts, all or some, in place of tasks")
    p.add_argument("--samples", default="1"), p.add_argument("--seed", default="42"), p.add_argument("--baseline", default="baseline"), p.add_argument("--port", default="3000")
    p.add_argument("--mode", choices=["rubric", "pairwise", "both"], default="both")
    p.add_argument("--force", action="store_true"), p.add_argument("--no-cache", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    logs.load_dotenv(Path(args.dir, ".env"))
    if args.command == "list":
        sources, config, interventions = load(args.dir)
        for kind, items in (("source", sources), ("model", config["models"]), ("intervention", interventions)):
            for x in items:
                print(kind, x["id"], x.get("title") or x.get("label") or x.get("name") or "", sep="\t")
        print("judge", config["judge"]["model"], sep="\t")
        return
    bench = Bench(args, spark or local_session())
    getattr(bench, args.command.replace("-", "_"))()


if __name__ == "__main__":
    main()
