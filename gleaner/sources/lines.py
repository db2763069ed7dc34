"""Text files as numbered lines, and JSON lines as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOCAL = (1 << 33) - 1


def numbered(rows: DataFrame, start: int = 0, out: str = "position") -> DataFrame:
    """Add the position in reading order, without gathering rows: a window over one count for each partition gives each one's start."""
    tagged = rows.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    counts = tagged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = tagged.withColumn("__of", part).join(F.broadcast(starts), F.col("__of") == F.col("__part"))  # a row a partition
    return joined.select(*rows.columns, (F.col("__start") + F.col("__id").bitwiseAND(_LOCAL) + start).alias(out))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line (from 1) of a text file."""
    return numbered(spark.read.text(path), 1, "line")


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as they come, by lines; a line's number isn't known in a stream and is 0."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).select("value", F.lit(0).cast("long").alias("line"))
