"""Near-duplicate texts of a similarity of about 0.8 and more, by SimHash segments and deletion-variant signatures.

A text's five-word shingles are put in the order of their hashes, as a ring. From each of SEGMENTS fixed places of the ring
the next TAKEN shingles give a SimHash of 32 bits: one segment of the text's signature. Two texts whose sets of shingles have
a Jaccard similarity of 0.8 have about 39 differing bits of 256 (31 at 0.85, 52 at 0.7), and as some segments hit none or few
of the shingles that differ, one segment differs by one bit at most far oftener than a segment of a SimHash over all
shingles. So each segment is indexed under its WIPED variants with four neighbouring bits wiped out, signatures meet under
an equal variant, and they link where at most DISTANCE bits of the whole signature differ. Of random pairs of sets 77 % are
linked at a similarity of 0.8, 94 % at 0.85, 99 % at 0.9 and more; 21 % at 0.7, 1 % at 0.6.

Equal signatures are one entry. The entries of a variant are linked by simhash's search, a row each and not a row for each
pair. A variant that more than CROWDED signatures share is first searched in parts of its own; then only entries that are
not in its largest class yet are compared with all others, again in bounded parts. So no group is unbounded, and no link
that joins classes is lost.

Defined cases: null texts are empty; texts without words link with each other; texts of fewer than five words have one
shingle; very long texts are read whole, shingle by shingle; repeated rows and ids keep a row each in near_duplicates(); a
null id never becomes a component's id unless it has no other; extra columns, whatever their names, are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch_rows, components, small_batches, text_of
from .simhash import SEED, best_rows, row_hash

SEGMENTS, TAKEN = 8, 7
WIPED = 8
DISTANCE = 48
WORDS = 5
#: Entries of a variant that are searched at once; rows of a batch, which is never more than that.
CROWDED, BATCH = 1 << 16, 1 << 14

_OF_SEGMENT = np.arange(1, SEGMENTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.arange(SEGMENTS, dtype=np.uint64) << np.uint64(61)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending. Only A-Z are lower-cased; words are split at ASCII white space."""
    split = text.encode("utf-8", "replace").lower().split()
    if not split:
        return np.empty(0, np.uint64)
    joined = b" ".join(split)
    digest = xxhash.xxh64_intdigest
    if len(split) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in split])
    starts = np.concatenate(([0], ends[:-words])).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), np.uint64, count=len(starts)))


def signature(text: str, words: int = WORDS) -> bytes:
    """SEGMENTS little-endian numbers of 32 bits; all zero for a text without words."""
    h = shingle_hashes(text, words)
    if not len(h):
        return bytes(4 * SEGMENTS)
    taken = min(TAKEN, len(h))
    x = h[(np.searchsorted(h, _PLACES)[:, None] + np.arange(taken)) % len(h)] ^ _OF_SEGMENT[:, None]
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    bits = np.unpackbits((x >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(SEGMENTS, taken, 4), axis=2).sum(1)
    return np.packbits(2 * bits > taken, axis=1).tobytes()


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, row: Column | None = None) -> DataFrame:
    """(doc_id, row, fp) with fp as four longs; row is a number that tells rows of one id apart, 0 if none is given."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.lit(0) if row is None else row).cast("long").alias("row"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = b"".join(signature(t, words) for t in b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), structs(np.frombuffer(made, "<i8").reshape(-1, len(LONGS)))], names=["doc_id", "row", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, fp {FP}")


LONGS = "abcd"[: SEGMENTS // 2]
FP = f"struct<{','.join(f'{c}:bigint' for c in LONGS)}>"


def structs(longs: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(longs[:, k])) for k in range(len(LONGS))], names=list(LONGS))


def variants() -> Column:
    """The keys of a signature: the number of a segment and of its wiped bits above the other bits."""
    parts = [p for c in LONGS for p in (F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(c), 32))]
    return F.array(*[p.bitwiseAND(F.lit(0xFFFFFFFF ^ (15 << 4 * k))).bitwiseOR(F.lit((WIPED * s + k) << 32)) for s, p in enumerate(parts) for k in range(WIPED)])


def near(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(others ^ x).sum(1) <= DISTANCE


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links, as places, that join all that links among distinct signatures can join: each is reached once and then left out of the search."""
    a, b = [], []
    left = np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(fp[x], fp[left])
            if hit.any():
                found, left = left[hit], left[~hit]
                a.append(np.full(len(found), x))
                b.append(found)
                queue += found.tolist()
    none = np.empty(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


LINK = "kind int, key long, a long, b long"


def rows_out(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key), pa.array(a), pa.array(b)], names=["kind", "key", "a", "b"])


def link_sorted(crowded: int | None):
    """Over rows (key, node, signature) sorted by key: (0, 0, node, node) for links, (1, key, node, node) for the rows of keys that over `crowded` rows have."""

    def groups(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(at)
        two = at[:-1][size == 2]
        ok = two[np.bitwise_count(fp[two] ^ fp[two + 1]).sum(1) <= DISTANCE]
        a, b = [node[ok]], [node[ok + 1]]
        for s in np.flatnonzero(size > 2):
            p, q = forest(fp[at[s] : at[s + 1]])
            a.append(node[at[s] + p])
            b.append(node[at[s] + q])
        ab = np.stack([np.concatenate(a), np.concatenate(b)], axis=1)
        if len(ab):
            ab = np.unique(ab, axis=0)  # a pair meets under several variants
            yield rows_out(0, np.zeros(len(ab), np.int64), np.ascontiguousarray(ab[:, 0]), np.ascontiguousarray(ab[:, 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, fp, over = np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, len(LONGS)), np.uint64), None
        for batch in batches:
            k, n, *longs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            f = np.stack([x.view(np.uint64) for x in longs], axis=1)
            if over is not None:
                end = int(np.searchsorted(k, over, "right")) if len(k) and k[0] == over else 0
                if end:
                    yield rows_out(1, k[:end], n[:end], n[:end])
                    k, n, f = k[end:], n[end:], f[end:]
                if len(k):
                    over = None
            key, node, fp = np.concatenate([key, k]), np.concatenate([node, n]), np.concatenate([fp, f])
            if not len(key):
                continue
            start = int(np.searchsorted(key, key[-1], "left"))  # the last group may go on
            if start:
                yield from groups(key[:start], node[:start], fp[:start])
                key, node, fp = key[start:], node[start:], fp[start:]
            if crowded is not None and len(key) > crowded:
                over = key[0]
                yield rows_out(1, key, node, node)
                key, node, fp = key[:0], node[:0], fp[:0]
        if len(key):
            yield from groups(key, node, fp)

    return run


def linked(scratch: Scratch, rows: DataFrame, crowded: int | None) -> DataFrame:
    """link_sorted() over (key, node, signature), written."""
    with batch_rows(rows.sparkSession, BATCH):
        return scratch.cut(rows.select("key", "node", *LONGS).repartition("key").sortWithinPartitions("key").mapInArrow(link_sorted(crowded), LINK), "linked")


def links(scratch: Scratch, distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links among the nodes of distinct signatures (node, fp) that join all that may be joined."""
    nodes = distinct.select("node", *[F.col(f"fp.{c}").alias(c) for c in LONGS])
    spread = nodes.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node")
    found = linked(scratch, spread.select(F.explode(variants()).alias("key"), "node", *LONGS), crowded)
    out = found.filter("kind = 0").select("a", "b")
    crowd = found.filter("kind = 1").select("key", F.col("a").alias("node"))
    if crowd.isEmpty():
        return out
    size = crowd.groupBy("key").agg(F.ceil(2 * F.count("*") / F.lit(crowded)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    placed = scratch.cut(crowd.join(size, "key").select("key", "node", "parts", part.alias("part")).join(nodes, "node"), "placed")
    inside = placed.select(F.xxhash64("key", "part").alias("key"), "node", *LONGS)
    out = out.union(linked(scratch, inside, None).select("a", "b"))
    # what is not in its key's largest class meets everything of the key: a part of the one and a part of the other at a time
    rooted = scratch.cut(placed.join(components(scratch, out), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    classes = rooted.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = classes.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0")
    most = most.select("key", F.col("m.root").alias("most"), F.ceil(2 * F.col("others") / F.lit(crowded)).cast("int").alias("other_parts"))
    open_ = scratch.cut(rooted.join(most, "key"), "open")
    if open_.isEmpty():
        return out
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("to")
    every = open_.select("key", "node", *LONGS, "part", to("other_parts")).withColumnRenamed("to", "other")
    mine = F.pmod(F.xxhash64("node"), F.col("other_parts")).cast("int")
    others = open_.filter("root <> most").select("key", "node", *LONGS, mine.alias("other"), to("parts")).withColumnRenamed("to", "part")
    both = every.unionByName(others).select(F.xxhash64("key", "part", "other").alias("key"), "node", *LONGS).distinct()
    return out.union(linked(scratch, both, None).select("a", "b"))


def classes(scratch: Scratch, fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(fp, root, component_id) for every distinct signature: a number that stands for its component, and the component's smallest id."""
    # the numbers are given as the table is written, and stay
    distinct = scratch.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "distinct")
    n = distinct.count()
    root = components(scratch, links(scratch, distinct.select("node", "fp"), crowded))
    rooted = scratch.cut(distinct.join(root, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root")), "rooted", n)
    least = scratch.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least", n)
    return scratch.cut(rooted.join(least, "root").select("fp", "root", "component_id"), "classes", n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest id that links reach."""
    scratch = Scratch(docs.sparkSession, "near")
    fps = scratch.cut(signatures(docs, id_col, text_col, words), "signatures")
    return fps.join(classes(scratch, fps, crowded), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, crowded: int = CROWDED) -> DataFrame:
    """The rows of docs, whole and with their columns, one for each component of near_duplicates(); see simhash.best_rows()."""
    scratch = Scratch(docs.sparkSession, "near")
    fps = scratch.cut(signatures(docs, id_col, text_col, words, row_hash(docs)), "signatures")
    return best_rows(scratch, docs, fps, classes(scratch, fps, crowded), id_col)
