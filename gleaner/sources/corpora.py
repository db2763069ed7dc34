"""Labelled message corpora in CSV files, brought to one schema: raw_text, label, source, row_id, sender, timestamp, attachment_slice."""

from __future__ import annotations

from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from gleaner.functions import text as T
from gleaner.sources.lines import numbered

# Label names of the two corpora, and when a date's text is tried in which form.
MESSAGE_LABELS = {"Safe Email": 0, "Phishing Email": 1}
MAIL_LABELS = {"0": 0, "1": 1}
DATE_FORMS = ("yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names in a CSV file's first line, without a byte-order mark."""
    first = spark.read.option("header", "true").csv(path).columns
    return [c.removeprefix("﻿") for c in first]


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Texts of a CSV file's columns (quoted fields may hold line breaks and doubled quotes); only these are parsed."""
    names = header_of(spark, path)
    schema = S.StructType([S.StructField(n, S.StringType()) for n in names])
    rows = spark.read.schema(schema).options(header="true", multiLine="true", quote='"', escape='"', enforceSchema="true").csv(path)
    return rows.select(*[F.col(f"`{c}`") for c in columns or names])


@F.pandas_udf(S.TimestampType())
def _mail_date(values: pd.Series) -> pd.Series:
    def parse(v):
        try:
            d = parsedate_to_datetime(v) if v else None
        except (TypeError, ValueError, IndexError):
            return None
        return None if d is None else (pd.Timestamp(d).tz_convert("UTC") if d.tzinfo else pd.Timestamp(d, tz="UTC")).tz_localize(None)

    return pd.to_datetime(values.map(parse))


def parse_date(text: Column) -> Column:
    """A timestamp in UTC from the usual forms and that of mail headers, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMS], _mail_date(text))


def _checked(rows: DataFrame, column: str, known: dict[str, int], what: str) -> None:
    seen = rows.agg(F.count_if(F.col(column).isNull()).alias("missing"), F.sort_array(F.collect_set(F.when(~F.col(column).isin(list(known)), F.substring(column, 1, 80)))).alias("unknown")).first()
    if seen.missing:
        raise ValueError(f"{what}: {seen.missing} rows have no label")
    if seen.unknown:
        raise ValueError(f"{what}: unknown labels {seen.unknown[:10]}")


def _canonical(rows: DataFrame, label: Column, source: str, sender: Column, timestamp: Column) -> DataFrame:
    placed = numbered(rows)
    return placed.select(
        "raw_text",
        label.cast("tinyint").alias("label"),
        F.lit(source).alias("source"),
        F.concat(F.lit(f"{source}:"), F.col("position").cast("string")).alias("row_id"),
        sender.alias("sender"),
        timestamp.alias("timestamp"),
        F.lit("unknown").alias("attachment_slice"),
    )


def _mapped(column: str, known: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col(column)]


def message_corpus(spark: SparkSession, path: str, source: str = "phishing_email") -> DataFrame:
    """A file with the columns `Email Text` and `Email Type`."""
    rows = read_csv(spark, path, ["Email Text", "Email Type"]).withColumnsRenamed({"Email Text": "raw_text", "Email Type": "kind"})
    _checked(rows, "kind", MESSAGE_LABELS, source)
    return _canonical(rows, _mapped("kind", MESSAGE_LABELS), source, F.lit(""), F.lit(None).cast("timestamp"))


def joined_text(subject: Column, body: Column) -> Column:
    """Subject, a blank line, body; the body alone where the subject is blank."""
    return F.when(F.trim(F.regexp_replace(subject, T.SPACE, " ")) != "", F.concat(subject, F.lit("\n\n"), body)).otherwise(body)


def mail_corpus(spark: SparkSession, path: str, source: str = "ceas_08") -> DataFrame:
    """A file with subject, body and label, maybe sender and date."""
    there = header_of(spark, path)
    rows = read_csv(spark, path, [c for c in ("subject", "body", "label", "sender", "date") if c in there])
    for c in ("sender", "date"):
        if c not in there:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumn("label", F.regexp_replace(F.trim("label"), r"\.0$", ""))
    _checked(rows, "label", MAIL_LABELS, source)
    rows = rows.withColumn("raw_text", joined_text(T.normalize_text(F.col("subject")), T.normalize_text(F.col("body"))))
    return _canonical(rows, F.col("label").cast("int"), source, F.coalesce("sender", F.lit("")), parse_date(F.col("date")))


def corpora(spark: SparkSession, messages: str, mails: str) -> DataFrame:
    return message_corpus(spark, messages).unionByName(mail_corpus(spark, mails))


def external_corpus(spark: SparkSession, path: str, *, most: int = 100_000, source: str = "external", prefix: str = "external", rows_expected: int | None = None, positives_expected: int | None = None) -> DataFrame:
    """A blind evaluation file: subject, body, date, label, maybe hash and attachments_count, under any case of these names.

    Message content is reduced to the prepared text and slices; raw text and sender don't leave this function.
    """
    rows = read_csv(spark, path)
    by_name = {c.strip().casefold(): c for c in rows.columns}
    if missing := {"subject", "body", "date", "label"} - set(by_name):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    rows = rows.select(*[F.col(f"`{c}`").alias(n) for n, c in by_name.items()])
    label = F.expr("try_cast(try_cast(label AS double) AS int)")
    rows = rows.withColumn("label", label)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad")).first()
    if seen.bad:
        raise ValueError("labels must be 0 or 1")
    if rows_expected is not None and seen.n != rows_expected:
        raise ValueError(f"{rows_expected} rows are expected, {seen.n} found")
    if positives_expected is not None and seen.positives != positives_expected:
        raise ValueError(f"{positives_expected} positive rows are expected, {seen.positives} found")
    raw = joined_text(F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    rows = rows.withColumn("raw_text", raw)
    named = F.coalesce("hash", F.lit("")) if "hash" in by_name else F.sha2("raw_text", 256)
    attached = F.expr("coalesce(try_cast(attachments_count AS double), 0)") if "attachments_count" in by_name else None
    rows = rows.select(
        "raw_text",
        F.col("label").cast("tinyint").alias("label"),
        F.lit(source).alias("source"),
        F.concat(F.lit(f"{prefix}:"), F.substring(F.sha2(named, 256), 1, 20)).alias("row_id"),
        parse_date(F.col("date")).alias("timestamp"),
        (F.lit("unknown") if attached is None else F.when(attached > 0, "has_attachment").otherwise("no_attachment")).alias("attachment_slice"),
        T.domains(F.concat(F.lit("\n"), F.col("raw_text"))).alias("found"),
        T.prepare_text(F.col("raw_text"), most)["text"].alias("text"),
    )
    made = T.message_metadata(F.concat(F.lit("\n"), F.col("raw_text")), F.col("found"))
    return rows.withColumns(made).drop("raw_text", "found")
