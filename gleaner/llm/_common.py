"""What the corpus operators share: the tools for scratch tables and skewed keys, and the bounds of an Arrow batch."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gleaner.plans.scratch import discard, kept, remove_folder, scratch, scratch_dir, stored
from gleaner.plans.skew import join_on_counted_key, numbered_within

__all__ = ["discard", "join_on_counted_key", "kept", "numbered_within", "remove_folder", "scratch", "scratch_dir", "stored", "use_small_arrow_batches"]

#: Rows and bytes of a batch that travels to Python, at most; the same for all operators, as plans run when they are read.
ARROW_ROWS = 1_024
ARROW_BYTES = 8 << 20


def use_small_arrow_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python in batches of so many rows and bytes at most, which bounds a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
