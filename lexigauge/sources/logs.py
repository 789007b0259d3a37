"""Run folders: append-only logs, snapshots, fixtures, environment files."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import check_run_id

#: What a run's folder has; a name ending in .jsonl is a log.
FILES = {"samples": "samples.jsonl", "scores": "scores.jsonl", "judgments": "judgments.jsonl", "votes": "votes.jsonl", "pairs": "pairs.json", "report": "report.json", "markdown": "report.md", "humanReport": "human-report.json", "cache": "cache"}


def run_files(root: str, run_id: str) -> dict[str, str]:
    return {k: f"{root.rstrip('/')}/{check_run_id(run_id)}/{v}" for k, v in FILES.items()}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a log with _seq, their order: the writer's own number, then the file's time and name, the place in the file, the line.

    Records without a number come before numbered ones. A missing log is empty; a broken line is an error.
    """
    order = "struct<n:bigint,t:timestamp,f:string,b:bigint,line:bigint>"
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, _seq {order}")
    df = spark.read.schema(f"{schema}, _seq bigint").option("mode", "FAILFAST").json(path)
    at = F.col("_metadata")
    # a block of a file is read by one task, whose ids grow with its lines
    place = F.struct(F.col("_seq").alias("n"), at["file_modification_time"].alias("t"), at["file_name"].alias("f"), at["file_block_start"].alias("b"), F.monotonically_increasing_id().alias("line"))
    return df.select("*", place.alias("_place")).withColumn("_seq", F.col("_place")).drop("_place")


def append_log(df: DataFrame, path: str, seq: str = "_seq") -> None:
    """Appends records; with a _seq column their order is kept whatever files they come to be in."""
    df.write.mode("append").option("ignoreNullFields", "true").json(path)


def next_seq(log: DataFrame) -> int:
    return (log.agg(F.max("_seq.n")).first()[0] or 0) + 1


def numbered(df: DataFrame, first: int, *order: str) -> DataFrame:
    """df with _seq for appending: unique, in the given order up to ties, without one task for all rows."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order) if order else df
    return ranged.withColumn("_seq", F.monotonically_increasing_id() + first)


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A snapshot's rows: an object on each line, or one array of objects."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    first = spark.read.text(path).first()
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", first is not None and first[0].lstrip().startswith("[")).json(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def fixture_sections(df: DataFrame, text: str = "value") -> DataFrame:
    """(…, id, body): the sections of texts that are cut by lines "=== id ===". A section that comes again replaces the one before."""
    body = F.regexp_replace(F.col(text), "\r\n", "\n")
    parts = F.filter(F.split(F.concat(F.lit("\n"), body), r"\n(?==== \S+ ===\n)", -1), lambda p: p.rlike(r"^=== \S+ ===\n"))
    rows = df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("_n", "_p"))
    made = rows.withColumn("id", F.regexp_extract("_p", r"^=== (\S+) ===\n", 1)).withColumn("body", F.regexp_replace(F.regexp_replace("_p", r"^=== \S+ ===\n", ""), r"^\s+|\s+$", ""))
    keys = [c for c in df.columns if c != text] + ["id"]
    return made.groupBy(*keys).agg(F.max_by("body", "_n").alias("body"))


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(style, id, body) of the fixture files of a folder; style is the file's name."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.md").select(F.regexp_extract("_metadata.file_name", r"^(.*)\.md$", 1).alias("style"), "value")
    return fixture_sections(df)


def parse_dotenv(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, quotes and a leading "export" are understood."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        m = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)
        if not m:
            continue
        value = m[2]
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        else:
            value = re.sub(r"\s+#.*$", "", value) if not value.startswith("#") else ""
        out[m[1]] = value
    return out


def load_dotenv(path: str | Path) -> dict[str, str]:
    """Sets what the environment does not have yet."""
    path = Path(path)
    found = parse_dotenv(path.read_text("utf-8")) if path.is_file() else {}
    for k, v in found.items():
        os.environ.setdefault(k, v)
    return found
