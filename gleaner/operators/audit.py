"""Cleaning a labelled corpus: empty texts, texts under both labels, repeated texts; and its distribution.

Input rows have raw_text, label (0 or 1), source, row_id. Nothing here gathers a text's copies in one task: whole
groups are judged by partial aggregation of narrow rows, and rows find the verdict by a join that splits hot texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.plans.scratch import materialised
from gleaner.plans.skew import join_on_counted_key


@dataclass(frozen=True)
class Audit:
    rows: DataFrame  # all rows with text, text_hash, fate: kept, empty, conflict or duplicate

    @property
    def clean(self) -> DataFrame:
        return self.rows.where("fate = 'kept'").drop("fate")

    @property
    def removed(self) -> DataFrame:
        return self.rows.where("fate <> 'kept'").select("row_id", "source", "label", "text_hash", "fate")

    def counts(self) -> DataFrame:
        """One row: how many rows each rule removed, and how many texts are under both labels."""
        fate = F.col("fate")
        return self.rows.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count_if(fate == f).alias(n) for f, n in (("kept", "clean_rows"), ("empty", "empty_count"), ("duplicate", "duplicate_count"), ("conflict", "conflicting_row_count"))],
            F.count_distinct(F.when(fate == "conflict", F.col("text_hash"))).alias("conflicting_hash_count"),
        )


def audit(corpus: DataFrame) -> Audit:
    """Judge every row. Of a text's copies the first by source, then row_id (as text), is kept."""
    named = corpus.withColumn("text", T.normalize_text(F.col("raw_text"))).drop("raw_text")
    named = materialised(named.withColumn("text_hash", T.text_hash(F.col("text"))))
    per_text = (
        named.where("text <> ''")
        .groupBy("text_hash")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("source", "row_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")  # most texts occur once and need no partner
    )
    joined = join_on_counted_key(named, per_text, "text_hash", "n", max(1, named.count()))  # a text of very many copies is one of few
    fate = (
        F.when(F.col("text") == "", "empty")
        .when(F.col("low") != F.col("high"), "conflict")
        .when(F.col("first").isNotNull() & (F.struct("source", "row_id") != F.col("first")), "duplicate")
        .otherwise("kept")
    )
    return Audit(joined.withColumn("fate", fate).drop("low", "high", "first", "n"))


def conflicting_rows(rows: DataFrame) -> DataFrame:
    """Rows (text_hash, label, ...) whose text is under more than one label."""
    both = rows.groupBy("text_hash").agg(F.count_distinct("label").alias("n")).where("n > 1").select("text_hash")
    return rows.join(both, "text_hash", "left_semi")


def distribution(rows: DataFrame) -> DataFrame:
    """Row counts for all rows, each source, each label and each pair: totals have null keys."""
    return rows.groupingSets([[], ["source"], ["label"], ["source", "label"]], "source", "label").agg(F.count(F.lit(1)).alias("rows"))


def check_labels(rows: DataFrame) -> None:
    """Fail unless labels are complete and both classes occur."""
    seen = rows.agg(F.count_if(F.col("label").isNull()).alias("missing"), F.sort_array(F.collect_set("label")).alias("labels")).first()
    if seen.missing:
        raise ValueError(f"{seen.missing} rows have no label")
    if [int(x) for x in seen.labels] != [0, 1]:
        raise ValueError("both labels are needed")
