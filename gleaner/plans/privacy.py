"""A scan of files to be released: full e-mail addresses, long numbers, long printable runs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What counts as a finding, on bytes read as Latin-1.
ADDRESS = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}"
LONG_NUMBER = r"(?<![0-9])[0-9]{9,}(?![0-9])"
PRINTABLE = r"[\x20-\x7e]{8,}"


class PrivacyError(RuntimeError):
    """Something to be released holds what looks like a personal identifier."""


def scan(files: DataFrame) -> DataFrame:
    """files: path, shown (text), size. One row: files, bytes, distinct emails and numbers, longest_run."""
    all_of = lambda p: F.regexp_extract_all("shown", F.lit(p), F.lit(0))
    found = files.select("size", all_of(ADDRESS).alias("e"), all_of(LONG_NUMBER).alias("n"), F.coalesce(F.array_max(F.transform(all_of(PRINTABLE), lambda r: F.length(r))), F.lit(0)).alias("run"))
    totals = found.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.max("run"), F.lit(0)).alias("longest_run"))
    each = found.select(F.explode(F.concat(F.transform("e", lambda x: F.struct(F.lit("e").alias("k"), x.alias("x"))), F.transform("n", lambda x: F.struct(F.lit("n").alias("k"), x.alias("x"))))).alias("f")).select("f.*").distinct()
    kinds = each.agg(F.count_if(F.col("k") == "e").alias("emails"), F.count_if(F.col("k") == "n").alias("numbers"))
    return totals.crossJoin(kinds).select("files", "bytes", "emails", "numbers", "longest_run")


def _passed(shown: DataFrame) -> dict[str, int | str]:
    seen = scan(shown).first().asDict()
    if seen["emails"] or seen["numbers"]:
        raise PrivacyError(f"{seen['emails']} e-mail addresses and {seen['numbers']} long numbers found")
    return seen | {"status": "passed"}


def _with_name(name: Column, content: Column) -> Column:
    """What is scanned of a file: its name below the folder, and its bytes as Latin-1."""
    return F.concat(name, F.lit("\n"), F.decode(content, "ISO-8859-1")).alias("shown")


def scan_folder(spark: SparkSession, folder: str) -> dict[str, int | str]:
    """Scan every file below a folder, and its name, but manifest.json and hidden ones; fails on any finding."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.regexp_replace("path", "^[a-z]+:/+", "/")
    inside = F.substring(below, F.lit(len(folder.rstrip("/")) + 1), F.length(below))
    kept = raw.where(~inside.rlike(r"(^|/)\.") & ~inside.rlike(r"(^|/)manifest\.json$"))
    return _passed(kept.select("path", _with_name(inside, F.col("content")), F.col("length").alias("size")))


def scan_bytes(spark: SparkSession, files: dict[str, bytes]) -> dict[str, int | str]:
    """The same of small files that the driver holds, by name."""
    rows = spark.createDataFrame(pa.table({"path": list(files), "content": pa.array(list(files.values()), pa.binary())}))
    return _passed(rows.select("path", _with_name(F.col("path"), F.col("content")), F.octet_length("content").alias("size")))
