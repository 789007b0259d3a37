"""Packing by optimal length buckets.

Texts become sequences of at most MAX_TOKENS tokens; a longer text is cut into several before every MAX_TOKENS-th token,
so that the sequences of a text one after the other are the text, and nothing is dropped. The global histogram of
sequence lengths has at most MAX_TOKENS + 1 entries; dynamic programming over it chooses the BUCKETS boundaries that
minimise padding, when every sequence is padded to its bucket's boundary. Inside a bucket sequences form batches of at
most `budget` padded tokens, and each row has its sequence's text, so a batch can be read as it is.

A token is a run of bytes other than ASCII white space; another tokenizer can be given as a function from a text to the
places where its tokens begin.

Batches follow a hash order of what is packed: id, sequence, text and, of equal rows, the copy's number. So the result is
the same however the input is spread, and equal rows, hot or not, are spread too. A sequence's place in its bucket is its
place in its shard plus the sizes of the shards before it, so that a bucket with most of the sequences is dealt over many
tasks.

Defined cases: null and empty texts are one empty sequence of no tokens, in the first bucket; very long texts are cut as
above; repeated rows are sequences of their own, with equal columns but for batch and slot; null ids stay; extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, text_of

MAX_TOKENS = 2048
BUCKETS = 12
BUDGET = 32_768
#: Sequences of all buckets that are numbered in one task, with their texts.
SHARD = 10_000


def boundaries(counts: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """The at most `buckets` boundaries, ascending, that minimise the padding of a histogram {length: count}.

    cost[k][j]: least padded tokens of the j shortest lengths in k buckets. The last bucket of those ends at the j-th
    length and takes every length from some i on. Of equal costs the one with fewer buckets, then with the smaller last
    bucket, is taken.
    """
    lengths = np.array(sorted(n for n, c in counts.items() if c > 0), dtype=np.int64)
    if not len(lengths):
        return []
    c = np.array([counts[int(n)] for n in lengths], dtype=np.float64)
    upto = np.concatenate(([0.0], np.cumsum(c)))
    n = len(lengths)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    came: list[np.ndarray] = []
    totals = []
    for _ in range(min(buckets, n)):
        new, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + lengths[j - 1] * (upto[j] - upto[:j])
            i = j - 1 - int(np.argmin(cost[::-1]))
            new[j], back[j] = cost[i], i
        came.append(back)
        totals.append(new[n])
        best = new
    k = int(np.argmin(totals))
    out, j = [], n
    while j > 0:
        out.append(int(lengths[j - 1]))
        j = int(came[k][j])
        k -= 1
    return out[::-1]


def padding(counts: dict[int, int], ends: list[int]) -> int:
    """Tokens of padding for a histogram under some boundaries."""
    at = np.searchsorted(ends, list(counts))
    return int(sum((ends[i] - n) * c for i, (n, c) in zip(at, counts.items())))


TOKEN = re.compile(r"[^ \t-\r]+")


def white_space_tokens(text: str) -> list[int]:
    """Where the runs of characters other than ASCII white space begin."""
    return [m.start() for m in TOKEN.finditer(text)]


def sequences(text: str, max_tokens: int = MAX_TOKENS, tokens: Callable[[str], Sequence[int]] | None = None) -> list[tuple[int, int, int]]:
    """(tokens, begin, end) of each sequence of a text, in code points; together they cover it."""
    if tokens is None:
        n = len(text.encode("utf-8", "replace").split())  # most texts are one sequence
        if n <= max_tokens:
            return [(n, 0, len(text))]
        tokens = white_space_tokens
    at = tokens(text)
    cuts = [0, *at[max_tokens::max_tokens], len(text)]
    return [(min(max_tokens, len(at) - k * max_tokens), a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Callable[[str], Sequence[int]] | None = None, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, n_tokens, begin, end, bucket_len, batch_id, slot, padding, text): a row for each sequence.

    piece counts the sequences of a document, which are its text from begin to end, in code points; batch_id is
    "<bucket_len>-<number>"; slot is the place in the batch.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text")).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, piece, n, begin, end, text = [], [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, (count, x, y) in enumerate(sequences(t, max_tokens, tokens)):
                    of.append(i), piece.append(k), n.append(count), begin.append(x), end.append(y)
                    text.append(t[x:y])
            made = [b.column(0).take(pa.array(of, pa.int64())), b.column(2).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(n, pa.int64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(made, names=["doc_id", "copies", "piece", "n_tokens", "begin", "end", "text"])

    rows = rows.select("doc_id", "text", "copies").mapInArrow(cut, f"doc_id {kind}, copies long, piece int, n_tokens long, begin long, end long, text string")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    rows = scratch.cut(rows.withColumn("h", F.xxhash64("doc_id", "piece", "text", "copy")), "sequences")
    counts = {r["n_tokens"]: r["count"] for r in rows.groupBy("n_tokens").count().collect()}  # at most max_tokens + 1 rows
    ends = boundaries(counts, buckets)
    bucket = F.coalesce(*[F.when(F.col("n_tokens") <= e, F.lit(e)) for e in ends]) if ends else F.lit(0)
    shards = max(1, -(-sum(counts.values()) // shard))
    rows = rows.select("*", bucket.cast("long").alias("bucket_len"), F.pmod("h", F.lit(shards)).cast("int").alias("shard"))
    sizes = rows.groupBy("bucket_len", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # a number for each shard and bucket
    offsets = scratch.cut(sizes.select("bucket_len", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    local = Window.partitionBy("bucket_len", "shard").orderBy("h", "doc_id", "piece", "copy")
    placed = rows.join(offsets, ["bucket_len", "shard"]).withColumn("place", F.col("offset") + F.row_number().over(local) - 1)
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return placed.select(
        "doc_id",
        "piece",
        "n_tokens",
        "begin",
        "end",
        "bucket_len",
        F.concat(F.col("bucket_len").cast("string"), F.lit("-"), F.floor(F.col("place") / room).cast("string")).alias("batch_id"),
        F.pmod(F.col("place"), room).cast("int").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        "text",
    )
