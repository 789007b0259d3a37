"""Removal of repeated passages by suffix sorting.

Every byte that a string of LENGTH bytes covers goes if that string also begins anywhere else, in the same document or
another one. Whether strings are equal is decided by suffixes and their common-prefix values in sorted order
(induced_sort), over shards that hold all strings that could be equal:

Each string of LENGTH bytes has a leading gram, the one of its GRAM-byte grams with the least hash, the leftmost of equal
ones. Neighbouring strings with the same gram are one piece. Equal strings have equal grams, so pieces are dealt to
shards by the gram. Only grams that come at least twice need a look, and pieces with equal bytes count as one: what is
alike as a whole needs no sorting, and a piece that copies have by the thousand is sorted once. What the suffixes of a
shard tell about a piece then holds for each of its places. Where more than CROWDED different pieces share a gram, they
are texts of another round, cut by the leading grams of another order, in which the grams that many of them have come
last: what differs in the strings then leads, so that they fall to other shards, and what is common to all becomes one
piece. Which grams come last is found in samples; equal strings have equal leading grams whatever is chosen. After LEVELS
rounds there are more only while each halves what is crowded; strings that consist of common grams alone can stay
crowded, and are sorted in one shard, whose text, numbers and tuples are on disk however large it is.

Distinct texts are worked on once, in a table bucketed by the text's hash, so that texts move once.

Defined cases: null and empty texts have no bytes and nothing to remove; a text shorter than LENGTH keeps all; very long
texts are cut to pieces like others; repeated
rows each lose what they share; ids, null or not, are only carried along; extra columns stay in keep() and are not read
in digest(); an empty table gives an empty result. Removal can leave a part of a character; keep() drops such bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_names, small_batches, text_of
from .induced_sort import Disk, repeats

LENGTH = 200
GRAM = 16
#: Bytes of distinct pieces that are sorted at once; a gram's pieces are never divided.
SHARD = 2 << 20
CROWDED, LEVELS = 5000, 4
#: Pieces of a crowded gram that are looked at for grams that many have, and their share that is many.
SEEN, MANY = 400, 0.02
POSITION_BITS = 24


def gram_hashes(data: np.ndarray, level: int = 0) -> np.ndarray:
    """A hash of the GRAM bytes from each position, of another order on each level."""
    raw = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data),), "<u8", raw, strides=(1,))
    h = word[: len(data) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += word[8 : len(data) - GRAM + 9]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    for _ in range(level):
        h = next_level(h)
    return h


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbouring values: prefix and suffix minima of blocks of w."""
    n = len(values)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    grid = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def next_level(h: np.ndarray) -> np.ndarray:
    """Hashes of grams on the level after theirs."""
    return (h ^ (h >> np.uint64(30))) * np.uint64(0xD6E8FEB86659FD93)


def pieces(data: np.ndarray, length: int = LENGTH, level: int = 0, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, start, number of strings) of the pieces of a text; piece k has the strings that start at start ... start + number - 1. Grams of common, sorted hashes of the level, come after all others."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    out_h, out_a, out_n = [], [], []
    step = (1 << POSITION_BITS) - length  # positions fit below the hash
    for a in range(0, n, step):
        part = data[a : min(a + step, n) + length - 1]
        h = gram_hashes(part, level)
        # equal hashes: the leftmost is least
        ranks = h
        if common is not None and len(common):
            late = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
            ranks = h >> np.uint64(1) | late.astype(np.uint64) << np.uint64(63)
        packed = ranks & ~np.uint64((1 << POSITION_BITS) - 1) | np.arange(len(h), dtype=np.uint64)
        best = window_minima(packed, length - GRAM + 1)
        new = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        out_h.append(h[(best[new] & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)].view(np.int64))
        out_a.append(new + a)
        out_n.append(np.diff(np.append(new, len(best))))
    return np.concatenate(out_h), np.concatenate(out_a), np.concatenate(out_n)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as maximal runs, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out)


class Shard:
    """Pieces that are sorted together: their bytes and numbers, in files once they are many."""

    def __init__(self, disk: Disk, numbers: int):
        self.disk, self.numbers = disk, numbers
        self.kept = [bytearray(), bytearray()]
        self.files: list = [None, None]
        self.size = 0

    def add(self, data: bytes, *numbers: int) -> None:
        self.size += len(data)
        # UTF-8 has no byte over 0xF4, and 0 ends a piece
        self.write(0, data.translate(_ONE_MORE) + b"\0")
        self.write(1, np.array([len(data), *numbers], np.int64).tobytes())

    def write(self, k: int, data: bytes) -> None:
        if self.files[k] is None:
            self.kept[k] += data
            if len(self.kept[k]) > 4 * self.disk.memory:
                self.files[k] = open(self.disk.path(), "w+b")
                self.files[k].write(self.kept[k])
                self.kept[k] = bytearray()
        else:
            self.files[k].write(data)

    def array(self, k: int, kind) -> np.ndarray:
        if self.files[k] is None:
            return np.frombuffer(self.kept[k], kind)
        self.files[k].close()
        return np.memmap(self.files[k].name, kind, "r")

    def repeats(self, length: int) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
        """For each piece its numbers and the ranges [a, b) of its strings that another string of the shard equals."""
        hit = repeats(self.array(0, np.uint8), length, self.disk)
        rows = self.array(1, np.int64).reshape(-1, 1 + self.numbers)
        at = 0
        for k in range(0, len(rows), 4096):
            for size, *numbers in np.asarray(rows[k : k + 4096]).tolist():
                row = hit[at : at + max(0, size - length + 1)]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], row.view(np.int8), [0])))).tolist() if row.any() else []
                yield numbers, list(zip(edge[::2], edge[1::2]))
                at += size + 1


_ONE_MORE = bytes((b + 1) % 256 for b in range(256))


def distinct_texts(scratch: Scratch, docs: DataFrame, text_col: str) -> tuple[str, DataFrame]:
    """A table's name and its rows (tk, copies, text), bucketed by tk, the first 16 bytes of the text's SHA-256. The caller drops it."""
    spark = docs.sparkSession
    rows = docs.select(text_of(text_col).alias("text")).select(text_key().alias("tk"), "text")
    found = rows.groupBy("tk").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"lexigauge_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found.write.format("parquet").option("path", scratch.path("texts")).option("compression", "zstd").bucketBy(buckets, "tk").saveAsTable(name)
    scratch.free()
    return name, spark.table(name)


def text_key(column: str = "text"):
    return F.unhex(F.substring(F.sha2(F.col(column).cast("binary"), 256), 1, 32))


FOUND = "array<struct<a:int,b:int>>"


def as_bytes(t: str | bytes) -> bytes:
    return t if isinstance(t, bytes) else t.encode("utf-8", "replace")


def repeated_spans(scratch: Scratch, texts: DataFrame, length: int = LENGTH, shard: int = SHARD, crowded: int = CROWDED, level: int = 0, common: np.ndarray | None = None, before: int | None = None) -> DataFrame:
    """(tk, spans): where each distinct text of (tk, copies, text) has strings that begin elsewhere too, as [a, b) in bytes.

    common: grams that come last on this level; before: how many pieces were crowded on the level before.
    """
    last = texts.sparkSession.sparkContext.broadcast(common)  # a few hundred grams for each crowded one

    def cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            keys, copies, gram, body, start, number = [], [], [], [], [], []
            for tk, n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = as_bytes(t)
                h, a, k = pieces(np.frombuffer(t, np.uint8), length, level, last.value)
                if not len(h):
                    continue
                gram.append(h)
                start.append(a)
                number.append(k)
                body += [digest(t[x:y]) for x, y in zip(a.tolist(), (a + k + length - 1).tolist())]
                keys += [tk] * len(h)
                copies += [n] * len(h)
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(copies, pa.int64()), pa.array(np.concatenate(gram)), pa.array(np.array(body, np.uint64).view(np.int64)), pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(number).astype(np.int32))],
                    names=["tk", "copies", "gram", "body", "start", "number"],
                )

    rows = scratch.cut(texts.select("tk", "copies", "text").mapInArrow(cut_pieces, "tk binary, copies long, gram long, body long, start int, number int"), "pieces")
    most = rows.count()
    # how often each kind of piece comes, and whether its gram has others; grams that come once need no look
    each = rows.groupBy("gram", "body").agg(F.sum("copies").alias("n"))
    grams = each.groupBy("gram").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1")
    # written first: then the join deals both sides anew, and a kind that a third of the pieces are can be split
    known = scratch.cut(each.join(grams, "gram").select("gram", "body", "n", (F.col("kinds") > 1).alias("mixed")), "known", most)
    looked_at = scratch.cut(rows.join(known, ["gram", "body"]), "looked_at", most)
    scratch.drop(rows, known)
    # pieces with equal bytes are one, and known as repeated by now; where all pieces of a gram are alike there is nothing to sort
    alike, single = looked_at.filter("n > 1"), looked_at.filter("mixed and n = 1")
    place = F.struct("tk", "start", "number")
    kinds = alike.filter("mixed").groupBy("gram", "body").agg(F.first("n").alias("n"), F.min(place).alias("one"))
    kinds = scratch.cut(kinds.unionByName(single.select("gram", "body", "n", place.alias("one"))), "kinds", most)
    hot = scratch.cut(kinds.groupBy("gram").agg(F.count("*").alias("many")).filter(F.col("many") > crowded), "crowded", most)
    still = hot.agg(F.sum("many")).first()[0] or 0
    if not still or level >= LEVELS and 2 * still > before:
        hot = None

    def fetched(some: DataFrame) -> DataFrame:
        """(gram, body, n, data) of some kinds of pieces."""
        wanted = some.groupBy("one.tk").agg(F.collect_list(F.struct("gram", "body", "one.start", "one.number", "n")).alias("want"))
        return texts.select("tk", "text").join(wanted, "tk").select("text", "want").mapInArrow(fetch, "gram long, body long, n long, data binary")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, body, n, data = [], [], [], []
            for t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = as_bytes(t)
                for w in want:
                    gram.append(w["gram"])
                    body.append(w["body"])
                    n.append(w["n"])
                    data.append(t[w["start"] : w["start"] + w["number"] + length - 1])
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(body, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=["gram", "body", "n", "data"])

    def seen_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for gram, t in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                h = np.unique(next_level(gram_hashes(np.frombuffer(t, np.uint8), level)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), gram, np.int64)), pa.array(h.view(np.int64))], names=["gram", "h"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: Shard) -> Iterator[pa.RecordBatch]:
            some = ((gram, body, [{"a": a, "b": b + length - 1} for a, b in spans]) for (gram, body, n), spans in held.repeats(length) if spans and n < 2)
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            while rows := list(islice(some, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind)], names=["gram", "body", "found"])

        disk, held, last = Disk(), None, None
        try:
            for b in batches:
                for gram, body, n, data in zip(*(c.to_pylist() for c in b.columns)):
                    if held is not None and held.size >= shard and gram != last:
                        yield from found(held)
                        disk.close()
                        disk, held = Disk(), None
                    held = held or Shard(disk, 3)
                    held.add(data, gram, body, n)
                    last = gram
            if held is not None:
                yield from found(held)
        finally:
            disk.close()

    dealt = fetched(kinds if hot is None else kinds.join(hot, "gram", "left_anti")).repartition("gram").sortWithinPartitions("gram")
    told = scratch.cut(dealt.mapInArrow(sort, f"gram long, body long, found {FOUND}"), "sorted")
    verdict = told
    if hot is not None:
        key = F.unhex(F.concat(F.lpad(F.hex("gram"), 16, "0"), F.lpad(F.hex("body"), 16, "0")))
        again = scratch.cut(fetched(kinds.join(hot, "gram", "left_semi")).select("gram", "body", key.alias("tk"), F.col("n").alias("copies"), F.col("data").alias("text")), "again")
        sample = kinds.join(F.broadcast(hot), "gram").filter(F.pmod(F.xxhash64("body"), F.ceil(F.col("many") / SEEN)) == 0).drop("many")
        counts = fetched(sample).mapInArrow(seen_grams, "gram long, h long").groupBy("gram", "h").count().join(F.broadcast(hot), "gram")
        often = counts.filter(F.col("count") >= F.greatest(F.lit(2), MANY * F.least("many", F.lit(SEEN)))).select("h").distinct().toArrow().column("h").to_numpy()
        later = next_level(common) if common is not None else np.empty(0, np.uint64)
        later = np.unique(np.concatenate([later, often.view(np.uint64)]))
        deeper = repeated_spans(scratch, again.select("tk", "copies", "text"), length, shard, crowded, level + 1, later, still)
        verdict = verdict.unionByName(again.filter("copies < 2").select("gram", "body", "tk").join(deeper, "tk").select("gram", "body", F.col("spans").alias("found")))
    verdict = scratch.cut(verdict, "verdict")
    # only pieces that come once need what the sorting found in them
    found = single.join(verdict, ["gram", "body"]).select("tk", F.explode("found").alias("f"), "start").select("tk", F.struct((F.col("start") + F.col("f.a")).alias("a"), (F.col("start") + F.col("f.b")).alias("b")).alias("s"))
    spans = alike.select("tk", F.struct(F.col("start").alias("a"), (F.col("start") + F.col("number") + length - 1).alias("b")).alias("s")).unionByName(found)
    out = scratch.cut(spans.groupBy("tk").agg(F.collect_list("s").alias("spans")), "spans", most)
    scratch.drop(looked_at, kinds, told, verdict)
    return out


def kept(scratch: Scratch, texts: DataFrame, length: int = LENGTH, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """(tk, n_bytes, n_removed, n_spans, kept) for each of distinct_texts(): its remaining bytes."""
    joined = texts.select("tk", "text").join(repeated_spans(scratch, texts, length, shard, crowded), "tk", "left").select("tk", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, count, left = [], [], [], []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t = t.encode("utf-8", "replace")
                s = merged([(x["a"], x["b"]) for x in s or ()])
                size.append(len(t))
                gone.append(sum(y - x for x, y in s))
                count.append(len(s))
                left.append(without(t, s))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(left, pa.binary())], names=["tk", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "tk binary, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "digest")
    name, texts = distinct_texts(scratch, docs, text_col)
    found = kept(scratch, texts, length, shard, crowded)
    found = scratch.cut(found.select("tk", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "digest")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text")).select("doc_id", text_key().alias("tk"))
    return rows.join(found, "tk").drop("tk")


def keep(docs: DataFrame, text_col: str = "text", length: int = LENGTH, shard: int = SHARD, crowded: int = CROWDED) -> DataFrame:
    """The rows and columns of docs with what remains of their texts; null texts stay null."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "kept")
    name, texts = distinct_texts(scratch, docs, text_col)
    changed = kept(scratch, texts, length, shard, crowded).filter("n_removed > 0")
    key, found, left = free_names(docs.columns, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode("utf-8", "ignore") for x in b.column(1).to_pylist()], pa.string())], names=[found, left])

    remains = scratch.cut(changed.select("tk", "kept").mapInArrow(run, f"{found} binary, {left} string"), "left")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    rows = docs.withColumn(key, F.unhex(F.substring(F.sha2(text_of(text_col).cast("binary"), 256), 1, 32)))
    text = F.when(F.col(f"`{text_col}`").isNotNull(), F.coalesce(left, F.col(f"`{text_col}`").cast("string"))).alias(text_col)
    return rows.join(remains, F.col(key) == F.col(found), "left").select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])
