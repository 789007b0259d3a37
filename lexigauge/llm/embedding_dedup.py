"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length 1. A coarse quantiser (k-means on at most SAMPLE distinct vectors) deals them into inverted
lists; what a vector differs from its list's centre is coded by a codebook for each of SUBSPACES subspaces. A vector
probes every list that can hold a link: its distance to the centre is at most the list's radius and a link's length, and
it is within a link's length of the plane between its own centre and the list's, as each member is nearest to its own. In
the lists, asymmetric distances (exact query, coded member) come from lookup tables; the coding error of every member is
known, so the bound "distance to the code minus the error" never rules out a pair that links. What is left is verified by
the exact cosine in double precision. So all links are found, in as many steps as the lists are apart: vectors without
any structure probe nearly all lists.

Equal vectors are one entry. Neighbouring lists are put together, and large ones cut, to blocks of the same size. Each
pair of blocks with lists that can hold a link is a bounded group, and gives sums and a spanning forest of its links, not
the links.

Vectors of one dimension are compared with each other; each dimension has an index of its own.

Defined cases: vectors that are null, empty, zero, or that hold null or non-finite components link with nothing; vectors
of different dimensions do not link; repeated vectors link with each other; a null id keeps its row and is no component's
id unless it has no other; very long vectors shorten the blocks; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, batch_rows, components

COSINE = 0.9
SAMPLE = 20_000
LIST_SIZE, MOST_LISTS = 160, 4096
SUBSPACES, CODES = 8, 64
BLOCK = 2048
SIDE = 8  # times BLOCK: vectors on one side of a group, fewer where they are long
SLACK = 1e-5  # of bounds, for rounding


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def nearest(x: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """Numbers of the n nearest centres, the nearest first."""
    out = np.empty((len(x), n), np.int32)
    half = (centres * centres).sum(1) / 2
    for i in range(0, len(x), 4096):
        d = half - x[i : i + 4096] @ centres.T
        if n == 1:
            out[i : i + 4096, 0] = d.argmin(1)
        else:
            part = np.argpartition(d, n - 1, axis=1)[:, :n] if n < d.shape[1] else np.tile(np.arange(d.shape[1]), (len(d), 1))
            out[i : i + 4096] = np.take_along_axis(part, np.take_along_axis(d, part, 1).argsort(1, kind="stable"), 1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    g = np.random.default_rng(seed)
    centres = x[g.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        who = nearest(x, centres)[:, 0]
        count = np.bincount(who, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, who, x)
        full = count > 0
        centres[full] = total[full] / count[full, None]
    return centres


class Index:
    """Centres of the inverted lists and the codebooks of residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        d = sample.shape[1]
        self.centres = kmeans(sample, lists)
        rest = sample - self.centres[nearest(sample, self.centres)[:, 0]]
        self.cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int)
        self.books = [kmeans(rest[:, a:b], CODES, 5) for a, b in zip(self.cuts, self.cuts[1:])]

    def code(self, x: np.ndarray, home: np.ndarray) -> np.ndarray:
        rest = x - self.centres[home]
        return np.stack([nearest(rest[:, a:b], book)[:, 0] for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Residuals of codes."""
        return np.concatenate([book[codes[:, k]] for k, book in enumerate(self.books)], axis=1)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each subspace the products of queries and codewords."""
        return [q[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]


def connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each member's component, for links a-b among n members."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if np.array_equal(least, label):
            return label
        label = least


def meeting(centres: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Whether members of two lists can be within reach, for all pairs of lists."""
    size = (centres * centres).sum(1)
    out = np.empty((len(centres), len(centres)), bool)
    for i in range(0, len(centres), 256):
        d = size[i : i + 256, None] + size[None, :] - 2 * centres[i : i + 256] @ centres.T
        out[i : i + 256] = d <= (radius[i : i + 256, None] + radius[None, :] + reach + SLACK) ** 2
    return out


def matched(index: Index, q: np.ndarray, qid: np.ndarray, qhome: np.ndarray, x: np.ndarray, xid: np.ndarray, xhome: np.ndarray, codes: np.ndarray, error: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, member row) that link; where both sides are the same vectors, each pair once."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))
    lists, place = np.unique(xhome, return_inverse=True)
    centres = index.centres[lists]
    radius = np.zeros(len(lists))
    np.maximum.at(radius, place, np.sqrt(((x - centres[place]) ** 2).sum(1)))
    code = centres[place] + index.decode(codes)
    # |q - c - r|^2 = |q|^2 + |c + r|^2 - 2 q.c - 2 q.r, and q.r is the sum of table entries
    fixed = 1 + (code * code).sum(1) - (reach + error + SLACK) ** 2
    size = (centres * centres).sum(1)
    order = np.argsort(qhome, kind="stable")
    step = 256
    for i in range(0, len(q), step):
        rows = order[i : i + step]
        part, home = q[rows], index.centres[qhome[rows]]
        product = part @ centres.T
        far = 1 + size[None, :] - 2 * product
        apart = np.sqrt(np.maximum((home * home).sum(1)[:, None] + size[None, :] - 2 * home @ centres.T, 0))
        probed = (far <= (radius + reach + SLACK)[None, :] ** 2) & (far - ((part - home) ** 2).sum(1)[:, None] <= 2 * reach * apart + SLACK)
        here = np.flatnonzero(probed.any(0)[place])
        tables = [np.ascontiguousarray(t.T, np.float32) for t in index.tables(part)]
        base = np.ascontiguousarray(product.T, np.float32)
        for k in range(0, len(here), BLOCK):
            some = here[k : k + BLOCK]
            near = base[place[some]]
            for n, t in enumerate(tables):
                near += t[codes[some, n]]
            c, r = np.nonzero(2 * near >= (fixed[some] - SLACK)[:, None].astype(np.float32))
            if len(r) * 32 > near.size:
                c, r = np.nonzero(x[some] @ part.T >= cosine)
            else:
                ok = np.concatenate([(part[r[s : s + (1 << 16)]] * x[some[c[s : s + (1 << 16)]]]).sum(1) >= cosine for s in range(0, len(r), 1 << 16)] or [np.empty(0, bool)])
                c, r = c[ok], r[ok]
            a, b = rows[r], some[c]
            if same:
                once = qid[a] < xid[b]
                a, b = a[once], b[once]
            if len(a):
                yield a, b


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    given = F.col(f"`{vector_col}`")
    # single-precision vectors are moved as they are, and computed with in double precision
    single = isinstance(vectors.schema[vector_col].dataType, T.ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (given if single else given.cast("array<double>")).alias("v"))
    sums = F.expr("aggregate(v, cast(0 as double), (s, x) -> s + cast(x as double) * cast(x as double))")
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.expr("forall(v, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))")
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    rows = rows.withColumn("ok", F.col("ok") & F.coalesce(F.when(F.col("ok"), sums) > 0, F.lit(False))).withColumn("v", F.when(F.col("ok"), F.col("v")))
    # two hashes stand for a vector where rows and vectors meet
    rows = scratch.cut(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v"), "d": F.when(F.col("ok"), F.size("v"))}), "vectors")
    dimensions = sorted(r["d"] for r in rows.filter("ok").select("d").distinct().collect())  # a number for each kind of vector
    out = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for d in dimensions:
        some = rows.filter(F.col("d") == d)
        with batch_rows(spark, 4096):
            found = classes(scratch, some, d, cosine, sample)
        out = out.unionByName(some.select("vec_id", "h1", "h2").join(found, ["h1", "h2"]).select("vec_id", "n_links", "component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def classes(scratch: Scratch, rows: DataFrame, dimension: int, cosine: float, sample: int) -> DataFrame:
    """(h1, h2, n_links, component_id) for the distinct vectors of rows (vec_id, v, h1, h2), which have one dimension."""
    spark = rows.sparkSession
    # equal vectors are one entry; its key is given as the table is written, and stays
    distinct = rows.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    distinct = scratch.cut(distinct.select(F.monotonically_increasing_id().alias("key"), "h1", "h2", "v", "copies", "least"), "distinct")
    n = distinct.count()
    chosen = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).select("v").toArrow().column("v").combine_chunks()
    chosen = unit(chosen.values.to_numpy(zero_copy_only=False).reshape(len(chosen), -1))
    index = Index(chosen, max(1, min(n // LIST_SIZE, MOST_LISTS, len(chosen))))
    shared = spark.sparkContext.broadcast(index)  # at most MOST_LISTS centres

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1)
            x = unit(v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            home = nearest(x, ix.centres)[:, 0]
            codes = ix.code(x, home)
            rest = x - ix.centres[home]
            error = np.sqrt(((rest - ix.decode(codes)) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), v, b.column(2), pa.array(home, pa.int32()), pa.array(np.sqrt((rest * rest).sum(1))), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["key", "v", "copies", "home", "off", "codes", "error"],
            )

    kind = distinct.schema["v"].dataType.simpleString()
    coded = scratch.cut(distinct.select("key", "v", "copies").mapInArrow(assign, f"key long, v {kind}, copies long, home int, off double, codes binary, error double"), "coded")
    size, radius = np.zeros(len(index.centres), np.int64), np.zeros(len(index.centres))
    for r in coded.groupBy("home").agg(F.count("*").alias("n"), F.max("off").alias("off")).collect():  # a row for each list
        size[r["home"]], radius[r["home"]] = r["n"], r["off"]
    block = BLOCK * max(1, min(SIDE, 512 // dimension))
    # near lists follow one another, and each block of so many places is of a few lists
    order = np.argsort(nearest(index.centres, kmeans(index.centres, max(1, n // block)))[:, 0], kind="stable")
    end = np.cumsum(size[order])
    begin = end - size[order]
    reach = meeting(index.centres[order], radius[order], np.sqrt(max(0.0, 2 - 2 * cosine)))
    blocks = [np.flatnonzero((begin < (k + 1) * block) & (end > k * block)) for k in range(-(-n // block))]
    rows_of = [np.logical_or.reduce(reach[b], axis=0) for b in blocks]
    meets = [(k, [j for j, b in enumerate(blocks) if some[b].any()]) for k, some in enumerate(rows_of)]
    places = spark.createDataFrame([(int(order[k]), int(begin[k]), int(size[order[k]])) for k in range(len(order)) if size[order[k]]], "home int, begin long, size long")
    meets = spark.createDataFrame(meets, "block int, others array<int>")
    dealt = coded.drop("off").join(F.broadcast(places), "home").withColumn("block", ((F.col("begin") + F.pmod(F.xxhash64("key"), "size")) / F.lit(block)).cast("int")).drop("begin", "size")
    dealt = dealt.join(F.broadcast(meets), "block").withColumn("other", F.explode("others")).drop("others")
    dealt = dealt.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "v", "copies", "home", "codes", "error")

    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def search(group: pa.Table) -> pa.Table:
        """n rows (a, null, n): links of a; rows (a, b, null): links that join what the group joins."""
        ix = shared.value
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        block = group.column("block").to_numpy()
        x = unit(group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1))
        keys, copies, home, error = (group.column(c).to_numpy() for c in ("key", "copies", "home", "error"))
        codes = np.frombuffer(b"".join(group.column("codes").to_pylist()), np.uint8).reshape(len(block), -1)
        ask, mem = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(mem) or not len(ask):
            return out.empty_table()
        total = np.zeros(len(keys))
        label = np.arange(len(keys))
        for r, c in matched(ix, x[ask], keys[ask], home[ask], x[mem], keys[mem], home[mem], codes[mem], error[mem], cosine, i == j):
            a, b = ask[r], mem[c]
            total += np.bincount(a, copies[b], len(keys)) + np.bincount(b, copies[a], len(keys))
            new = label[a] != label[b]
            if new.any():
                label = connect(len(keys), label[a[new]], label[b[new]])[label]
        some = np.flatnonzero(total)
        joined = np.flatnonzero(label != np.arange(len(keys)))
        none = pa.nulls(len(some), pa.int64())
        return pa.concat_tables([
            pa.Table.from_arrays([pa.array(keys[some]), none, pa.array(total[some].astype(np.int64))], schema=out),
            pa.Table.from_arrays([pa.array(keys[joined]), pa.array(keys[label[joined]]), pa.nulls(len(joined), pa.int64())], schema=out),
        ])

    found = scratch.cut(dealt.groupBy("i", "j").applyInArrow(search, "a long, b long, n long"), "found")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    root = components(scratch, found.filter("b is not null").select("a", "b"))
    known = distinct.select("key", "h1", "h2", "copies", "least").join(counts, "key", "left").join(root.withColumnRenamed("node", "key"), "key", "left")
    known = scratch.cut(known.select("h1", "h2", F.coalesce("root", "key").alias("root"), "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "known")
    least = scratch.cut(known.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return scratch.cut(known.join(least, "root").select("h1", "h2", "n_links", "component_id"), "classes")


#: The same by all pairs, in DuckDB's SQL.
SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
d AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM g),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM d a JOIN d b ON a.vec_id <> b.vec_id AND CASE WHEN len(a.v) = len(b.v) THEN list_dot_product(a.v, b.v) / (a.size * b.size) ELSE -1 END >= {COSINE}),
r AS (SELECT vec_id AS n, vec_id AS m FROM d UNION SELECT r.n, l.y FROM r JOIN l ON r.m = l.x),
c AS (SELECT n, min(m) AS least FROM r GROUP BY n), k AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, coalesce(c.least, e.vec_id) AS component_id, coalesce(c.least, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN k ON k.x = e.vec_id LEFT JOIN c ON c.n = e.vec_id
"""
