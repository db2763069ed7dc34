"""Session settings shared by tests, the bench and the command line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "gleaner", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; a running session is reused as it is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    use_small_arrow_batches(spark)
    return spark


#: Rows and bytes of a batch that travels to Python, at most.
ARROW_ROWS = 1_024
ARROW_BYTES = 2 << 20


def use_small_arrow_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in batches of so many rows and bytes at most, which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a small table that lies in fewer files than there are cores among all of them; any other stays as it is.

    Spark can't split a row group, so a table of one is read in one task, with all the work on its texts. Such a table
    is below a full split a core, so the shuffle is small; larger tables and tables of many files are never shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < cores * split and 0 < len(df.inputFiles()) < cores else df
