"""Session settings the engine relies on."""

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(name: str = "lexigauge", cores: str = "8", partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session, as tests and benchmarks use it."""
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(partitions), "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"} | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName(name).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as there are cores, where it comes in fewer splits: for expressions that cost far more than moving a row. Inputs of many splits stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
