"""Fill-in-the-middle examples: a text's prefix and suffix come first, and the middle is what is left to be told.

DuckDB runs inside mapInArrow: each Arrow batch is registered as a table, one SQL statement cuts the texts into units
(`regexp_extract_all`), draws two cuts and a form from a digest of the key (`sha256`), joins the parts again
(`list_slice`, `array_to_string`) and gives Arrow back, so no row passes through Python. Nothing is shuffled or gathered;
a batch has ARROW_ROWS rows and ARROW_BYTES bytes at most, and DuckDB holds some ten times these.

A unit is a word with the white space before it, or white space that ends the text. Forms: plain (the text as it is),
psm (`<P>`prefix`<S>`suffix`<M>`middle) and spm (`<S>`suffix`<P>`prefix`<M>`middle). `restored` undoes them.

Defined cases: a null text counts as empty; an empty text, and one that holds a marker, stays plain; a null key is drawn
as the empty key; rows with equal keys are drawn alike, each on its own; a very long text is one row, cut whole in the
memory that DuckDB has; bytes that are no UTF-8 give way to U+FFFD; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm._common import use_small_arrow_batches

#: Before the prefix, the suffix and the middle; a text that holds one of them stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNITS}') AS units,
         sha256($seed || ':' || coalesce(doc_id::VARCHAR, '')) AS drawn FROM batch
), draws AS (
  SELECT doc_id, text, units, len(units) AS n,
         list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(drawn, i, 8))::BIGINT) AS h FROM texts
), cuts AS (
  SELECT doc_id, text, units, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h[3] % 100 >= $percent THEN 'plain'
              WHEN h[4] % 100 < $spm_percent THEN 'spm' ELSE 'psm' END AS form FROM draws
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, low), '') AS prefix,
         array_to_string(list_slice(units, low + 1, high), '') AS middle, array_to_string(list_slice(units, high + 1, n), '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       CASE form WHEN 'plain' THEN text
                 WHEN 'psm' THEN concat('{PREFIX}', prefix, '{SUFFIX}', suffix, '{MIDDLE}', middle)
                 ELSE concat('{SUFFIX}', suffix, '{PREFIX}', prefix, '{MIDDLE}', middle) END AS output
FROM parts
"""


def _transformed(seed: int, percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        settings = {"threads": 1, "temp_directory": "", "autoinstall_known_extensions": False, "autoload_known_extensions": False}
        with duckdb.connect(":memory:", config=settings) as db:
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                told = db.sql(SQL, params={"seed": str(seed), "percent": percent, "spm_percent": spm_percent}).to_arrow_table()
                db.unregister("batch")
                yield from told.cast(ARROW).to_batches()

    return run


def fill_in_middle(docs: DataFrame, *, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output.

    percent of all texts are transformed, and of these spm_percent put the suffix first; both and the cuts come from
    the digest of seed and doc_id alone, so reruns agree and a new document changes no other.
    """
    use_small_arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.make_valid_utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(_transformed(seed, percent, spm_percent), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A text that was transformed holds no marker, nor can one arise at a seam, so the markers part it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = F.get(parts, 1), F.get(parts, 2), F.get(parts, 3)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """The transformation with the digests of each output and of the text restored from it, in place of the output."""
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    made = fill_in_middle(docs)
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    return made.select(*names, digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
