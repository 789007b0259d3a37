"""Votes as a stream: the batch log read as files arrive. An extension; the batch operators are the reference for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.human import valid_vote
from ..schema import VOTES


def vote_stream(spark: SparkSession, path: str) -> DataFrame:
    """Votes of a folder of JSON lines, with the time they were made."""
    return spark.readStream.schema(VOTES).json(path).withColumn("at", F.to_timestamp("createdAt"))


def first_votes(votes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Valid votes, one for each rater and pair; what comes later than `late` is no longer compared, so that the state stays bounded."""
    return votes.filter(valid_vote()).withWatermark("at", late).dropDuplicatesWithinWatermark(["raterId", "pairId"])


def tallies(votes: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Counts of choices for each pair and window of time."""
    c = F.col("choice")
    return votes.groupBy(F.window("at", window), "pairId").agg(F.count_if(c == "A").alias("a"), F.count_if(c == "B").alias("b"), F.count_if(c == "tie").alias("tie"))


def append_to(votes: DataFrame, path: str, checkpoint: str):
    """A query that appends votes to a log as they come."""
    return votes.drop("at").writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
