"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits and two link when 3 or fewer differ. Cut into two segments of 32 bits, one segment of such a
pair differs by one bit at most. So each segment is indexed under its 32 variants with one bit wiped out, the pair meets
under an equal variant, and the count of differing bits verifies it. Equal fingerprints are one entry of the index.

Entries that share a variant are linked in one pass over the shuffled, sorted index by a search that drops each entry
once it is reached: copies by the thousand cost a row each, not a row for each pair. A variant that more than CROWDED
fingerprints share goes to a second level, cut again by variants of the other segment's 16-bit halves; 18 free bits
remain there, so no group can exceed 262,144 entries whatever the data.

Defined cases: null texts are empty; an empty text has fingerprint zero and links like any other; very long texts are
hashed whole, in blocks; repeated rows and repeated ids keep a row each; a null id keeps its row and never becomes a component's id unless it has no other (then
null); extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, batch_rows, components, free_names, small_batches, table, text_of

DISTANCE = 3
SEED = 42
CROWDED = 1 << 16


def fingerprint(text: str, words: int = 3) -> int:
    """The SimHash of a text's word shingles, unsigned. Only A-Z are lower-cased; words are split at ASCII white space."""
    split = text.encode("utf-8", "replace").lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    if len(split) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in split])
    starts = np.concatenate(([0], ends[: -words])).tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts))
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        total += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, row: Column | None = None) -> DataFrame:
    """(doc_id, row, fp) with fp as a signed long; row is a number that tells rows of one id apart, 0 if none is given."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.lit(0) if row is None else row).cast("long").alias("row"), text_of(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "row", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, row long, fp long")


def forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join all that links among distinct fingerprints can join: each is reached once and then left out of the search."""
    left, a, b = fps, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= DISTANCE
            if near.any():
                hits = left[near]
                left = left[~near]
                a += [int(x)] * len(hits)
                b += hits.tolist()
                queue += list(hits)
    return a, b


LINKS = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def link_sorted(crowded: int):
    """Over rows (key, fp) sorted by key: (0, fp, fp) for links, (1, key, fp) for the rows of keys that over `crowded` rows have."""

    def signed(x) -> np.ndarray:
        return np.asarray(x, dtype=np.uint64).view(np.int64)

    def groups(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(at)
        two = at[:-1][size == 2]
        x, y = fp[two], fp[two + 1]
        # a pair with an equal segment meets under all 32 variants; the first one is enough
        tag = key[two] >> 32
        shift = np.where(tag >= 32, 32, 0).astype(np.uint64)
        same = (((x ^ y) >> shift) & np.uint64(0xFFFFFFFF)) == 0
        ok = (np.bitwise_count(x ^ y) <= DISTANCE) & (~same | (tag % 32 == 0))
        a, b = [signed(x[ok])], [signed(y[ok])]
        for s in np.flatnonzero(size > 2):
            p, q = forest(np.unique(fp[at[s] : at[s + 1]]))
            if p:
                a.append(signed(p))
                b.append(signed(q))
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            ab = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield table(LINKS, [np.zeros(len(ab), np.int32), np.ascontiguousarray(ab[:, 0]), np.ascontiguousarray(ab[:, 1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        over = None
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            f = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if over is not None:
                n = int(np.searchsorted(k, over, "right")) if len(k) and k[0] == over else 0
                if n:
                    yield table(LINKS, [np.ones(n, np.int32), k[:n], f[:n].view(np.int64)])
                    k, f = k[n:], f[n:]
                if len(k):
                    over = None
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if not len(key):
                continue
            start = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on
            if start:
                yield from groups(key[:start], fp[:start])
                key, fp = key[start:], fp[start:]
            if len(key) > crowded:
                over = key[0]
                yield table(LINKS, [np.ones(len(key), np.int32), key, fp.view(np.int64)])
                key, fp = key[:0], fp[:0]
        if len(key):
            yield from groups(key, fp)

    return run


def one_wildcard(fp: str = "fp"):
    """64 keys: the segment's number and wiped-out bit above the segment's other bits."""
    part = [F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(fp), 32)]
    return F.array(*[part[s].bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).bitwiseOR(F.lit((32 * s + i) << 32)) for s in (0, 1) for i in range(32)])


def second_level(key: str = "a", fp: str = "b"):
    """32 keys below a crowded one: the other segment's halves, each with one bit wiped out."""
    other = F.when(F.shiftright(F.col(key), 32) >= 32, F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(F.col(fp), 32))
    half = [other.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(other, 16)]
    return F.array(*[half[s].bitwiseAND(F.lit(0xFFFF ^ (1 << i))).bitwiseOR(F.lit((16 * s + i) << 16)) for s in (0, 1) for i in range(16)])


def links(scratch: Scratch, distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links among the distinct fingerprints `fp` that join all that may be joined."""
    spark = distinct.sparkSession
    schema = "kind int, a long, b long"
    # spread first: each row becomes 64
    spread = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = spread.select(F.explode(one_wildcard()).alias("key"), "fp").repartition("key").sortWithinPartitions("key")
    with batch_rows(spark, 1 << 16):
        found = scratch.cut(index.mapInArrow(link_sorted(crowded), schema), "found")
    out = found.filter("kind = 0").select("a", "b")
    crowd = found.filter("kind = 1")
    if not crowd.isEmpty():
        # a distance of 3 leaves 3 at most in the other segment, so one of its halves differs by one bit at most
        again = crowd.select("a", "b", F.explode(second_level()).alias("v")).select(F.xxhash64("a", "v").alias("key"), F.col("b").alias("fp")).repartition("key").sortWithinPartitions("key")
        with batch_rows(spark, 1 << 16):
            out = out.union(scratch.cut(again.mapInArrow(link_all, schema), "found").select("a", "b"))
    return out


def link_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As link_sorted for bounded groups of hashed keys: no pair is left to another key."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def groups(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        for s in np.flatnonzero(np.diff(at) > 1):
            p, q = forest(np.unique(fp[at[s] : at[s + 1]]))
            if p:
                yield table(LINKS, [np.zeros(len(p), np.int32), np.array(p, np.uint64).view(np.int64), np.array(q, np.uint64).view(np.int64)])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if len(key):
            start = int(np.searchsorted(key, key[-1], "left"))
            if start:
                yield from groups(key[:start], fp[:start])
                key, fp = key[start:], fp[start:]
    if len(key):
        yield from groups(key, fp)


def classes(scratch: Scratch, fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint: a fingerprint that stands for its component, and the component's smallest id."""
    distinct = scratch.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n = distinct.count()
    root = components(scratch, links(scratch, distinct.select("fp"), crowded))
    rooted = scratch.cut(distinct.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted", n)
    least = scratch.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least", n)
    return scratch.cut(rooted.join(least, "root").select("fp", "root", "component_id"), "classes", n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest id that links reach."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    return fps.join(classes(scratch, fps, crowded), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, crowded: int = CROWDED) -> DataFrame:
    """The rows of docs, whole and with their columns, one for each component of near_duplicates(); see best_rows()."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.cut(fingerprints(docs, id_col, text_col, words, row_hash(docs)), "fingerprints")
    return best_rows(scratch, docs, fps, classes(scratch, fps, crowded), id_col)


def row_hash(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)])


def best_rows(scratch: Scratch, docs: DataFrame, fps: DataFrame, rooted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of docs for each root: of its smallest id, and of that id's rows the one with the least hash of all columns. fps: (doc_id, row, fp); rooted: (fp, root)."""
    row, best_id, best_row, number = free_names(docs.columns, 4)
    best = fps.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("b"))
    best = scratch.cut(best.select(F.col("b.doc_id").alias(best_id), F.col("b.row").alias(best_row)), "best")
    found = docs.withColumn(row, row_hash(docs)).join(best, (F.col(row) == F.col(best_row)) & F.col(f"`{id_col}`").eqNullSafe(F.col(best_id)), "left_semi")
    # rows that are equal in every column are still one row
    nth = F.row_number().over(Window.partitionBy(row, F.col(f"`{id_col}`")).orderBy(F.lit(0)))
    return found.withColumn(number, nth).filter(F.col(number) == 1).drop(row, number)
