"""Tables between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder below that of spark.checkpoint.dir. Only where that setting is absent and the master is local, as in tests, a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexigauge-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/lexigauge"


def written(df: DataFrame) -> DataFrame:
    """df as a written table in the shared folder: the lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())
