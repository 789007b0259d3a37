"""People's votes on pairs: intake, assignment, and what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import random_draw, ratio, rater_seed, round_half_up
from .report import majority_votes

BODY_LIMIT = 16 * 1024
RATER_LIMIT, COMMENT_LIMIT = 64, 2000
CHOICES = ("A", "B", "tie")


def valid_vote(comments: bool = False) -> Column:
    """Whether a vote's fields are as they must be. comments: votes have a column of them."""
    named = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    short = F.coalesce(F.length("comment") <= COMMENT_LIMIT, F.lit(True)) if comments else F.lit(True)
    return named("pairId") & named("raterId") & (F.length("raterId") <= RATER_LIMIT) & short & F.coalesce(F.col("choice").isin(*CHOICES), F.lit(False)) & F.col("leftWasA").isNotNull() & F.coalesce(F.col("seconds") >= 0, F.lit(True))


def intake(votes: DataFrame, pairs: DataFrame, quota: int | None = None, seq: str = "_seq") -> DataFrame:
    """votes with the status each gets as it comes in: 413, 400, 404, 409, 403 or 200.

    The first vote of a rater on a pair counts; with a quota, a rater's votes beyond it are refused. What went before is
    a running count in the order of arrival, of votes that could count at all.
    """
    known = pairs.select(F.col("id").alias("pairId")).distinct().withColumn("_known", F.lit(True))
    marked = votes.join(known, "pairId", "left")
    size = F.col("bytes") if "bytes" in votes.columns else F.lit(0)
    early = F.when(size > BODY_LIMIT, 413).when(~valid_vote("comment" in votes.columns), 400).when(F.col("_known").isNull(), 404)
    marked = marked.withColumn("_early", early)
    possible = F.col("_early").isNull()
    nth = F.row_number().over(Window.partitionBy("raterId", "pairId", possible).orderBy(seq))
    marked = marked.withColumn("_nth", F.when(possible, nth))
    counting = F.count_if(possible & (F.col("_nth") == 1)).over(Window.partitionBy("raterId").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("_before", F.coalesce(counting, F.lit(0)))
    over = F.lit(False) if quota is None else F.col("_before") >= quota
    status = F.coalesce("_early", F.when(F.col("_nth") > 1, 409).when(over, 403).otherwise(200)).cast("int")
    return marked.withColumn("status", status).drop("_known", "_early", "_nth", "_before")


def on_pairs(votes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Votes on pairs that are current."""
    return votes.join(pairs.select(F.col("id").alias("pairId")), "pairId", "left_semi")


def assign(pairs: DataFrame, votes: DataFrame, raters: DataFrame, per_rater: int | None = None) -> DataFrame:
    """(raterId, pairId, place): the pairs that each rater gets next, those with the fewest votes first, then in the rater's own random order.

    pairs: (pairId, ord), ord counting from 0; raters: (raterId). What a rater has answered is left out and counts against per_rater.
    """
    votes = votes.join(pairs, "pairId", "left_semi")
    tally = votes.groupBy("pairId").agg(F.count("*").alias("n"))
    answered = votes.select("raterId", "pairId").distinct()
    done = answered.groupBy("raterId").agg(F.count("*").alias("done"))
    counted = pairs.join(tally, "pairId", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if per_rater is not None:
        # a rater's answers and next pairs are per_rater together, so the pairs with the fewest votes that are as many hold all that anyone gets
        upto = F.sum("pairs").over(Window.orderBy("n"))  # a row for each number of votes
        reached = counted.groupBy("n").agg(F.count("*").alias("pairs")).withColumn("upto", upto).filter(F.col("upto") >= per_rater).agg(F.min("n")).first()[0]
        counted = counted if reached is None else counted.filter(F.col("n") <= reached)
    # every rater meets every pair that may be next: that is the operator's meaning
    open_ = raters.crossJoin(counted).join(answered, ["raterId", "pairId"], "left_anti")
    order = Window.partitionBy("raterId").orderBy("n", random_draw(rater_seed(F.col("raterId")), F.col("ord")), "pairId")
    placed = open_.select("raterId", "pairId", F.row_number().over(order).alias("place"))
    if per_rater is None:
        return placed
    # the first filter lets each task keep only the first of a rater before they are shuffled
    allowed = placed.filter(F.col("place") <= per_rater).join(done, "raterId", "left")
    return allowed.filter(F.col("place") <= F.lit(per_rater) - F.coalesce("done", F.lit(0))).drop("done")


def tallies(votes: DataFrame) -> DataFrame:
    """(pairId, votes, a, b, tie, verdict) of pairs with votes."""
    return majority_votes(votes, ["pairId"])


def inter_rater(votes: DataFrame) -> DataFrame:
    """One row (pairs, agree, rate): pairs with two votes or more, and on how many of those all are alike."""
    per_pair = votes.groupBy("pairId").agg(F.count("*").alias("n"), (F.min("choice") == F.max("choice")).alias("alike")).filter("n >= 2")
    return per_pair.agg(F.count("*").alias("pairs"), F.count_if("alike").alias("agree")).withColumn("rate", round_half_up(ratio(F.col("agree"), F.col("pairs")), 3))


def median_seconds(votes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The exact median; the mean of two middle values is rounded to one place."""
    timed = votes.filter("seconds is not null")
    m, n = F.median("seconds"), F.count("*")
    return timed.groupBy(*(by or [])).agg(F.when(n % 2 == 0, round_half_up(m, 1)).otherwise(m).alias("medianSeconds"))


def summary(votes: DataFrame) -> DataFrame:
    """One row: votes, raters, agreement among raters, median seconds."""
    head = votes.agg(F.count("*").alias("votes"), F.count_distinct("raterId").alias("raters"))
    return head.join(inter_rater(votes)).join(median_seconds(votes), how="left")


def choice_of(side: Column, left_was_a: Column) -> Column:
    """What was chosen, from the side of the screen it was on."""
    return F.when(side == "tie", "tie").when((side == "left") == left_was_a, "A").otherwise("B")
