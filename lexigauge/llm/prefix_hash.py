"""Document fingerprints from prefix polynomial hashes.

Over a text's code points c, the prefix array P[i] = sum of c[j] * B^j for j < i, modulo a prime, makes any two spans
comparable without reading them: P[i + n] - P[i], brought to a common power, is the hash of n code points from i. Two
primes (about 2^61 together) make chance equality negligible. Longest common extensions come from a binary search over
span equality.

A fingerprint is the hash of the whole text followed by a sketch of its spans of 16 code points (4 in a text under 64
code points, 2 under 16), the k-th time that a span comes counting as a span of its own: their hashes, modulo both
primes, are dealt over SLOTS slots and each slot keeps 16 bits of its least one. The share of slots that two sketches
agree on estimates the likeness of their bags of spans. Equal texts have equal fingerprints.

What two texts have in common at their beginning and at their end is found by longest extensions, without comparing code
points: edits() gives both for a text and its edited version, and whether the span equality of the prefix arrays says
that the part before the edit is the same.

Defined cases: null texts are empty; an empty text has an empty sketch and is like an empty text only; very long texts
are read whole; extra columns are not read; an empty table gives an empty result. See edits() for ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, text_of

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)
#: (from this many code points on, span length)
SPANS = ((64, 16), (16, 4), (0, 2))
SLOTS = 128
EMPTY = 0xFFFF
#: Ranges that edits() deals rows out to; their ends are the only thing the driver holds.
MOST_RANGES = 20_000

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(k: int, n: int) -> np.ndarray:
    """B^0 ... B^(n-1) modulo the k-th prime; kept and doubled as texts get longer."""
    p = _powers[k]
    prime = np.uint64(PRIMES[k])
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(BASES[k], len(p), PRIMES[k])) % prime])
    _powers[k] = p
    return p[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix(points: np.ndarray, k: int) -> np.ndarray:
    """The prefix array modulo the k-th prime, one longer than the text."""
    out = np.zeros(len(points) + 1, np.uint64)
    prime = np.uint64(PRIMES[k])
    terms = (points.astype(np.uint64) + np.uint64(1)) * powers(k, len(points)) % prime
    np.cumsum(terms, out=out[1:])  # below 2^63 for texts of up to 2^32 code points
    return out % prime


class Prefixes:
    """A text's prefix arrays: span hashes, span equality and longest common extensions."""

    def __init__(self, text: str):
        self.points = code_points(text)
        self.arrays = [prefix(self.points, k) for k in range(len(PRIMES))]

    def __len__(self) -> int:
        return len(self.points)

    def equal(self, i: int, other: Prefixes, j: int, n: int) -> bool:
        """Whether n code points from i equal n code points of the other text from j."""
        if min(i, j, n) < 0 or i + n > len(self) or j + n > len(other):
            return False
        for k, prime in enumerate(PRIMES):
            a = (int(self.arrays[k][i + n]) - int(self.arrays[k][i])) % prime
            b = (int(other.arrays[k][j + n]) - int(other.arrays[k][j])) % prime
            low = min(i, j)
            if a * pow(BASES[k], j - low, prime) % prime != b * pow(BASES[k], i - low, prime) % prime:
                return False
        return True

    def common(self, i: int, other: Prefixes, j: int) -> int:
        """The longest common extension from i and j, by binary search."""
        low, high = 0, min(len(self) - i, len(other) - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def common_end(self, other: Prefixes) -> int:
        """The longest common extension backwards from both ends, by binary search."""
        low, high = 0, min(len(self), len(other))
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(len(self) - middle, other, len(other) - middle, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def whole(self) -> int:
        """62 bits of the whole text and its length's effect."""
        a, b = (int(x[-1]) for x in self.arrays)
        return (a << 31 | b) ^ (len(self) * 0x9E3779B97F4A7C15 & 0x3FFFFFFFFFFFFFFF)

    def spans(self, n: int) -> np.ndarray:
        """62-bit hashes of all spans of n code points: those modulo both primes, brought to the power of place 0, so that texts of different lengths compare."""
        size = len(self)
        n = min(n, size)
        out = np.zeros(size - n + 1 if size else 0, np.uint64)
        for k, prime in enumerate(PRIMES if size else ()):
            m, p = np.uint64(prime), self.arrays[k]
            back = np.uint64(pow(pow(BASES[k], -1, prime), size - n, prime))
            at_last = (p[n:] + m - p[:-n]) % m * powers(k, size)[size - n :: -1][: size - n + 1] % m
            out = out << np.uint64(31) | at_last * back % m
        return out


def sketch(text: Prefixes) -> np.ndarray:
    """The least span hash of each slot, 16 bits of it."""
    size = len(text)
    n = next(span for least, span in SPANS if size >= least)
    out = np.full(SLOTS, EMPTY, np.uint16)
    if size == 0:
        return out
    h = np.sort(text.spans(n))
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    nth = (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))).astype(np.uint64)
    h = (h + nth * np.uint64(0xBF58476D1CE4E5B9)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    slot = (h >> np.uint64(57)).astype(np.int64)
    least = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, slot, h & np.uint64((1 << 57) - 1))
    full = least != np.iinfo(np.uint64).max
    out[full] = (least[full] >> np.uint64(20) & np.uint64(0xFFFF)).astype(np.uint16) % EMPTY
    return out


def fingerprint(text: str) -> tuple[str, np.ndarray]:
    """(the fingerprint as hex digits, its sketch)."""
    return fingerprint_of(Prefixes(text))


def fingerprint_of(p: Prefixes) -> tuple[str, np.ndarray]:
    s = sketch(p)
    return f"{p.whole():016x}" + s.astype(">u2").tobytes().hex(), s


def read_sketch(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint[16:]), ">u2").astype(np.uint16)


def likeness(a: str, b: str, sa: np.ndarray | None = None, sb: np.ndarray | None = None) -> float:
    """0 to 1: the share of the slots in use that two fingerprints agree on; 1 for equal ones."""
    if a == b:
        return 1.0
    sa, sb = read_sketch(a) if sa is None else sa, read_sketch(b) if sb is None else sb
    used = (sa != EMPTY) | (sb != EMPTY)
    n = int(used.sum())
    return float(((sa == sb) & used).sum() / n) if n else 0.0


def edited(text: str, following: str | None) -> str:
    """The text with its last third replaced by as much of the beginning of the following one."""
    m = len(text) // 3
    return text[: len(text) - m] + (following or "")[:m]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) for every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t)[0] for t in texts], pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_range: int = 2000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, same_before, same_at_begin, same_at_end) for every row.

    Rows follow one another by descending id, null ids last, rows of one id by descending hash of their text; after the
    last row comes the first. The order is cut into ranges of about per_range rows, so texts move once; each range also
    gets a copy of the first row of the next one. An id that fills ranges by itself, and rows without an id, are cut by
    the hashes of their texts; only rows that are alike in both stay together, and are read one by one. Beyond
    MOST_RANGES ranges these get longer: a range is sorted, spilling, and streamed.

    same_before: whether the text and its edited version are equal up to the edit, by their prefix arrays; same_at_begin
    and same_at_end: how many code points they share there, by longest extensions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "edits")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    sizes = docs.agg(F.count("*").alias("n"), F.count_if(F.col(f"`{id_col}`").isNull()).alias("none")).first()
    cuts = max(1, min(sizes["n"] // per_range, MOST_RANGES))
    marks = list(rows.select(F.percentile_approx("doc_id", [k / cuts for k in range(1, cuts)] or [0.5], 10 * max(cuts, 100)).alias("m")).first()["m"] or []) if sizes["n"] else []
    often = {m: marks.count(m) for m in set(marks) if marks.count(m) > 1}
    # range 0 has the largest ids; a null id goes behind all; an id that is a mark more than once has a range of its own
    found = sorted({*marks, *(m + 1 for m in often)})
    edges = spark.createDataFrame([(found,)], "edges array<long>")
    below = "(s.lo + s.hi) div 2"
    step = f"if(s.lo >= s.hi, s, if(get(edges, cast({below} as int)) <= doc_id, named_struct('lo', {below} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {below})))"
    from_last = (F.size("edges") - F.expr(f"aggregate(sequence(1, 16), named_struct('lo', 0L, 'hi', cast(size(edges) as bigint)), (s, n) -> {step}).lo")).cast("int")
    ranged = rows.crossJoin(F.broadcast(edges)).withColumn("range", F.when(F.col("doc_id").isNull(), F.size("edges") + 1).otherwise(from_last)).drop("edges")  # one row of marks
    slices = {len(found) - found.index(m) - 1: n + 1 for m, n in often.items()} | {len(found) + 1: sizes["none"] // per_range + 1}
    many = spark.createDataFrame([(r, min(n, MOST_RANGES)) for r, n in slices.items()], "range int, slices int")  # a row for each mark that came twice
    upper = F.shiftrightunsigned(F.col("th").bitwiseXOR(F.lit(-(1 << 63))), 32)  # grows with the hash
    part = F.shiftrightunsigned((F.lit((1 << 32) - 1) - upper) * F.col("slices"), 32)
    ranged = ranged.join(F.broadcast(many), "range", "left").withColumn("range", F.col("range").cast("long") * MOST_RANGES + F.when(F.col("slices") > 1, part).otherwise(0)).drop("slices")
    firsts = scratch.cut(ranged.groupBy("range").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "th", "text")).alias("r")).select("range", "r.doc_id", "r.text", "r.th"), "firsts")
    order = sorted(r["range"] for r in firsts.select("range").collect())  # one number for each range
    before = spark.createDataFrame([(b, a) for a, b in zip(order, order[1:] + order[:1])], "range long, previous long")
    copies = firsts.join(F.broadcast(before), "range").select("doc_id", "text", "th", F.col("previous").alias("range"), F.lit(1).alias("copy"))
    parts = ranged.select("doc_id", "text", "th", "range", F.lit(0).alias("copy")).unionByName(copies)
    parts = parts.repartition("range").sortWithinPartitions("range", "copy", F.col("doc_id").desc_nulls_last(), F.col("th").desc(), F.col("text").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose following one is not read yet
        for b in batches:
            out: list[tuple] = []
            for doc_id, text, copy in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()):
                p = Prefixes(text)
                fp, s = fingerprint_of(p)
                if held is not None:
                    i, t, f, sk, own = held
                    e = edited(t, text)
                    changed = Prefixes(e)
                    ef, es = fingerprint_of(changed)
                    same = own.equal(0, changed, 0, len(t) - len(t) // 3)
                    begin = own.common(0, changed, 0)
                    out.append((i, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), f, ef, likeness(f, ef, sk, es), likeness(f, fp, sk, s), same, begin, min(own.common_end(changed), len(t) - begin) if begin < len(t) else 0))
                held = None if copy else (doc_id, text, fp, s, p)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_before", "same_at_begin", "same_at_end"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_before boolean, same_at_begin long, same_at_end long"
    return parts.mapInArrow(run, schema)
