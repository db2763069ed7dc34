"""Exact deduplication by two-pass Bloom filtering.

Pass one reads every text once and stores (doc_id, digest). A filter of saturating two-bit counters then marks
each digest whose counters all reached two: every repeated digest is marked, and a few others. Only marked rows
are shuffled and grouped by their full digest; all others pass straight through as groups of one.

Bounds. A filter has FILTER_BITS_PER_ROW slots a row up to MAX_FILTER_SLOTS; it is broadcast, so its size has that
fixed bound. Of more rows than one filter serves, the digests are written in ranges of their hash, without a shuffle,
and each range has a filter of its own, one after the other: the filters together grow with the rows, one alone
doesn't. A group of any size is counted by partial aggregation and joined back through `join_on_counted_key`, so no
task holds a whole group.

Defined cases: a null text counts as empty; all empty texts are equal; rows with equal text and equal doc_id are
one document listed repeatedly: the first of them (in no stated order) is kept, the rest dropped; a null doc_id
is larger than every other; a very long text is hashed where it is read and doesn't travel. Other columns are ignored by `exact_duplicates` and kept by `drop_exact_duplicates`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm._common import join_on_counted_key, scratch_dir, stored

FILTER_BITS_PER_ROW = 16
MAX_FILTER_SLOTS = 1 << 28
SEGMENT_SLOTS = 1 << 20
HASHES = 3


def normalised(text: Column) -> Column:
    """Each run of space, tab, newline, vertical tab, form feed and carriage return as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _slots(digests: pa.Array, slots: int) -> np.ndarray:
    """HASHES slot numbers for each 32-byte digest."""
    flat = np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)
    return (flat[:, :HASHES] % np.uint64(slots)).astype(np.int64)


def _partial_filters(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, dtype=np.uint8)
        seen = False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            seen = True
            for column in _slots(batch.column(0), slots).T:
                add = np.bincount(column, minlength=0).astype(np.int64) if slots <= 1 << 22 else None
                if add is not None:
                    counts[: len(add)] = np.minimum(counts[: len(add)] + np.minimum(add, 2), 2)
                else:
                    where, n = np.unique(column, return_counts=True)
                    counts[where] = np.minimum(counts[where] + np.minimum(n, 2), 2)
        if not seen:
            return
        for s in range(0, slots, SEGMENT_SLOTS):
            part = counts[s : s + SEGMENT_SLOTS]
            if part.any():
                once, twice = np.packbits(part > 0).tobytes(), np.packbits(part > 1).tobytes()
                yield pa.RecordBatch.from_pydict({"segment": pa.array([s // SEGMENT_SLOTS], pa.int32()), "bits": pa.array([zlib.compress(once + twice, 1)], pa.binary())})

    return run


def _merge_filters(table: pa.Table) -> pa.Table:
    once = twice = None
    for packed in table.column("bits").to_pylist():
        both = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)
        a, b = both[: len(both) // 2], both[len(both) // 2 :]
        once, twice = (a.copy(), b.copy()) if once is None else (once | a, twice | b | (once & a))
    return pa.table({"segment": table.column("segment")[:1].cast(pa.int32()), "bits": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())})


def _marker(slots: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.zeros(-(-slots // 8), dtype=np.uint8)
        for segment, bits in held.value:
            part = np.frombuffer(zlib.decompress(bits), dtype=np.uint8)
            start = segment * SEGMENT_SLOTS // 8
            twice[start : start + len(part)] = part
        for batch in batches:
            slot = _slots(batch.column("digest"), slots)
            hit = ((twice[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).all(axis=1).astype(bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], names=[*batch.schema.names, "marked"])

    return run


def mark_repeats(digests: DataFrame, total: int) -> tuple[DataFrame, Broadcast]:
    """Add marked, true for every row whose 32-byte digest occurs more than once, and for a few others. With it comes the filter, to be destroyed when the rows are read."""
    spark = digests.sparkSession
    slots = max(8192, min(MAX_FILTER_SLOTS, 1 << max(0, total * FILTER_BITS_PER_ROW - 1).bit_length()))
    parts = digests.select("digest").mapInArrow(_partial_filters(slots), "segment int, bits binary")
    merged = parts.groupBy("segment").applyInArrow(_merge_filters, "segment int, bits binary")
    held = spark.sparkContext.broadcast([(r.segment, bytes(r.bits)) for r in merged.collect()])  # at most MAX_FILTER_SLOTS / 8 bytes
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in digests.schema) + ", marked boolean"
    return digests.mapInArrow(_marker(slots, held), schema), held


def marked_in_turn(parts: list[DataFrame], total: int) -> DataFrame:
    """The marked rows of all parts, stored: each part is written and its filter destroyed before the next one's is made, so one is alive at a time."""
    spark = parts[0].sparkSession
    folder, schema = scratch_dir(spark), None
    for k, p in enumerate(parts):
        marked, held = mark_repeats(p, total)
        marked.write.parquet(f"{folder}/marked-{k}")
        schema = marked.schema
        held.destroy()
    return spark.read.schema(schema).parquet(*[f"{folder}/marked-{k}" for k in range(len(parts))])


def _in_ranges(digests: DataFrame, ranges: int) -> list[DataFrame]:
    """The stored rows, in tables of about equal size by a hash of the digest; tasks write their part of each, so nothing is shuffled."""
    if ranges == 1:
        return [stored(digests, "digests")]
    spark = digests.sparkSession
    path = f"{scratch_dir(spark)}/digests"
    digests.withColumn("range", F.pmod(F.xxhash64("digest"), F.lit(ranges)).cast("int")).write.partitionBy("range").parquet(path)
    held = spark.read.schema(digests.schema.add("range", "integer")).parquet(path)
    return [held.where(F.col("range") == r).drop("range") for r in range(ranges)]


def exact_duplicates(docs: DataFrame, filter_slots: int = MAX_FILTER_SLOTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. filter_slots: of one filter; of more rows than it serves, there are ranges."""
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)).alias("digest"))
    total = docs.count()
    ranges = max(1, -(-total * FILTER_BITS_PER_ROW // filter_slots))
    parts = _in_ranges(digests, ranges)
    marked = marked_in_turn(parts, -(-total // ranges)) if total else digests.limit(0).withColumn("marked", F.lit(False))
    alone = marked.where(~F.col("marked")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    rows = marked.where(F.col("marked")).select("doc_id", "digest")
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    joined = join_on_counted_key(rows, groups, "digest", "group_size", total)
    # repeated rows of the kept document: the first stays
    first = F.row_number().over(W.partitionBy("digest", "doc_id").orderBy("doc_id")) == 1
    is_keep = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    grouped = joined.where(is_keep).withColumn("kept", first).unionByName(joined.where(~is_keep).withColumn("kept", F.lit(False)))
    both = alone.unionByName(grouped.select("doc_id", "keep_id", "group_size", "kept", "digest"))
    return both.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: every text once, from its smallest doc_id.

    Rows without a doc_id can't be named by the result and all stay; so do equal rows of one kept document.
    """
    gone = exact_duplicates(docs).where(~F.col("kept") & (F.col("doc_id") != F.col("keep_id"))).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
