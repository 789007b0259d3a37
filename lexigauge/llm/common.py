"""What several operators share: shared scratch tables, Arrow row streams and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Short rows that one file of a written table has at least, where their number is known.
ROWS_A_FILE = 100_000
#: Rows per Arrow batch for columns of whole texts; a batch of long texts stays within a worker's memory.
TEXT_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where that is unset and the master is local, as in tests, a temporary one is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexigauge-"))
    return context.getCheckpointDir()


class Scratch:
    """Tables written to the shared folder: they cut the lineage and outlive a lost executor. Each is removed when dropped, the rest when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/lexigauge/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)
        self.fs.deleteOnExit(path)
        self.n = 0

    def path(self, label: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{label}-{self.n}"

    def cut(self, df: DataFrame, label: str = "t", rows: int | None = None) -> DataFrame:
        """Writes df and reads it back. rows: how many short rows it has at most, if that is known: few rows come in few files."""
        path = self.path(label)
        if rows is not None and (files := 1 + rows // ROWS_A_FILE) < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(files)
        # numbers are written plainly: the stronger codec's buffers lie outside the heap, for each column and task
        plain = all(isinstance(f.dataType, T.NumericType | T.BooleanType) for f in df.schema)
        df.write.option("compression", "snappy" if plain else "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that cut() made and nothing reads any more, and lets Spark free the shuffle files of what wrote them."""
        for df in frames:
            if path := vars(df).get("_path"):
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)
        self.free()

    def free(self) -> None:
        """Shuffle files go once the driver has noticed that their plans are gone."""
        self.spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bounds Arrow batches before whole texts go to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside; what others run later keeps its own size."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def text_of(column: str) -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_names(columns: Sequence[str], n: int) -> list[str]:
    """n names that no column has, whatever the case."""
    taken, out, k = {c.lower() for c in columns}, [], 0
    while len(out) < n:
        if (name := f"_own{k}") not in taken:
            out.append(name)
        k += 1
    return out


def table(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def held_out(column: str = "doc_id") -> Column:
    """Rows that no classifier learns from: a remainder of the id's checksum."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, total: int, largest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, label) of a bounded sample of labelled documents outside the held-out fold, whole texts in the order of a hash of the id.

    The bounds: `most` labelled ids; of those no text of more than `largest` bytes; and as many as are `total` bytes together.
    Repeated label rows of a document count by their majority (a tie counts as 1), null labels and ids not at all.
    Of documents that share an id one is taken, the one with the smallest text.
    """
    chosen = (
        labels.select(F.col(id_col).alias("k"), F.col(label).cast("double").alias("y"))
        .filter(F.col("k").isNotNull() & F.col("y").isNotNull())
        .groupBy("k")
        .agg((F.avg("y") >= 0.5).cast("int").alias("y"))
        .filter(~held_out("k"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(most)
    )
    texts = docs.select(F.col(f"`{id_col}`").alias("k"), text_of(text_col).alias("text")).filter(F.octet_length("text") <= largest)
    # `most` ids and labels: a bounded table
    scratch = Scratch(docs.sparkSession, "sample")
    found = scratch.cut(texts.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("text").alias("text"), F.first("y").alias("y")), "sample")
    upto = F.sum("size").over(Window.orderBy(F.xxhash64("k"), "k"))
    fits = found.select("k", F.octet_length("text").cast("long").alias("size")).withColumn("upto", upto).filter(F.col("upto") <= total).select("k")
    return found.join(F.broadcast(fits), "k").select("text", "y")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): one root for each connected component.

    Each round merges every node into the neighbour, or itself, whose hash is least, and keeps the edges between
    merged nodes; a constant share of the nodes goes in a round, whatever the labels. Nodes stay spread over tasks:
    the least neighbour is a pre-aggregated minimum, and the joins have one row for a node on one side, so a hub's
    rows can be split. Edges from a node to itself are ignored.
    """
    pairs = lambda a, b: edges_of.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    edges_of = edges
    left = scratch.cut(pairs("a", "b"), "edges")
    nodes = None
    roots: DataFrame | None = None
    for n in range(10_000):
        if not (size := left.count()):
            break
        both = left.union(left.select("b", "a"))
        rank = lambda c, n=n: F.struct(F.xxhash64(F.lit(n), c).alias("h"), F.col(c).alias("n"))
        to = both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).alias("m")).select(F.col("a").alias("node"), F.col("m.n").alias("root"))
        to = scratch.cut(to, "merge", 2 * size)
        nodes = 2 * size if nodes is None else nodes
        edges_of = left.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        less = scratch.cut(pairs("ra", "rb"), "edges", size)
        if roots is None:
            merged = to
        else:
            step = to.select(F.col("node").alias("root"), F.col("root").alias("next"))
            merged = scratch.cut(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots", nodes)
            scratch.drop(roots, to)
        scratch.drop(left)
        roots, left = merged, less
    return roots if roots is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of each batch as lists."""
    for b in batches:
        if b.num_rows:
            yield [c.to_pylist() for c in b.columns]
