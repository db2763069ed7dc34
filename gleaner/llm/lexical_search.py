"""Ranked lexical search: the documents that score highest for each query, by MaxScore in shards of an inverted index.

One pass cuts every whole text into terms and keeps, shard by shard, an inverted list of each term that a query asks for:
places of documents and counts. A shard is one stored row of SHARD_DOCS documents or SHARD_POSTINGS postings at most,
made where the texts are read, so texts aren't shuffled. Document frequencies are summed over the shards by partial
aggregation. A second pass searches each shard for all queries:

  * Each list's upper bound is its largest contribution in the shard. A query's lists are taken by falling bounds. As long
    as a document that has been in none of them could still reach the threshold (the k-th best score so far), the list is
    essential: all its postings are scored.
  * Once the bounds of the rest add up to less than the threshold, the rest is non-essential: only documents whose score
    so far plus the rest's bounds reaches the threshold are looked up in it, and fewer after each list.

The threshold is carried from shard to shard within a task. Scores are whole numbers, and only what is strictly below
the threshold is passed over, so the result is exact, ties included. A task gives k documents a query at most, and these
are merged in two steps, so no task gathers more than k rows of MERGE_GROUPS groups.

Queries are answered in blocks of about BLOCK_TERMS distinct terms, dealt by a hash of the item; a block's terms and their
frequencies are what the driver holds and broadcasts. Of more blocks than one, each reads the texts anew.

Defined cases: a null text, or one without terms, is no document and matches nothing; an item without terms has no rows;
rows of one item_id are one item with the terms of all of them, a null one being an item as well; rows with one doc_id are
documents of their own; a null doc_id comes last among equal scores; a very long text is cut piece by piece, PIECE bytes
at a time; bytes that are no UTF-8 are read as they are; empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm._common import discard, stored, use_small_arrow_batches

SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 21
BLOCK_TERMS = 1 << 18
MERGE_GROUPS = 256
PIECE = 1 << 20
#: All that parts terms becomes a space and A-Z become small; signs beyond ASCII stay, so cutting bytes at spaces cuts terms.
FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

SHARD = "documents long, terms_in_all long, doc_ids binary, has_id binary, lengths binary, terms array<int>, frequencies array<int>, places binary, counts binary"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a list for each PIECE bytes or a little more."""
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = sorted({t for piece in _pieces(text or b"") for t in piece})
            for at in range(0, len(found), 10_000):
                part = found[at : at + 10_000]
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([item] * len(part), pa.int64()), "term": pa.array(part, pa.binary())})


class _Shard:
    """Documents and postings of a shard in the making; documents without an asked term are counted only."""

    def __init__(self) -> None:
        self.documents = self.terms_in_all = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.sizes: list[int] = []
        self.terms: list[int] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, length: int, found: Counter) -> None:
        self.documents += length > 0
        self.terms_in_all += length
        if found:
            self.ids.append(doc_id)
            self.lengths.append(length)
            self.sizes.append(len(found))
            self.terms.extend(found.keys())
            self.counts.extend(found.values())

    def row(self) -> pa.RecordBatch:
        terms, counts = np.array(self.terms, np.int32), np.array(self.counts, np.int64)
        places = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        order = np.argsort(terms, kind="stable")  # by term, then by place
        each, often = np.unique(terms, return_counts=True)
        has = np.array([i is not None for i in self.ids], bool)
        row = {
            "documents": pa.array([self.documents], pa.int64()),
            "terms_in_all": pa.array([self.terms_in_all], pa.int64()),
            "doc_ids": pa.array([np.array([i or 0 for i in self.ids], np.int64).tobytes()], pa.binary()),
            "has_id": pa.array([has.tobytes()], pa.binary()),
            "lengths": pa.array([np.array(self.lengths, np.int64).tobytes()], pa.binary()),
            "terms": pa.array([each.astype(np.int32)], pa.list_(pa.int32())),
            "frequencies": pa.array([often.astype(np.int32)], pa.list_(pa.int32())),
            "places": pa.array([places[order].tobytes()], pa.binary()),
            "counts": pa.array([counts[order].tobytes()], pa.binary()),
        }
        return pa.RecordBatch.from_pydict(row)


def _indexed(held, shard_docs: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(held.value)}
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_buffer()
                found, length = Counter(), 0
                for piece in _pieces(raw.to_pybytes() if raw is not None else b""):
                    length += len(piece)
                    found.update(map(number.get, piece))
                found.pop(None, None)
                shard.add(doc_id, length, found)
                if len(shard.ids) >= shard_docs or len(shard.terms) >= shard_postings:
                    yield shard.row()
                    shard = _Shard()
        if shard.documents:
            yield shard.row()

    return run


def build_shards(docs: DataFrame, terms: list[bytes], shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """docs: doc_id, text (binary). A stored row for each shard, its postings those of these terms, numbered by their places in the list."""
    held = docs.sparkSession.sparkContext.broadcast(terms)  # BLOCK_TERMS terms, or those of one item
    return stored(docs.mapInArrow(_indexed(held, shard_docs, shard_postings), SHARD), "shards")


class _Best:
    """The k best documents of each query so far, by falling score, then by rising id (none last)."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.found: list[list[tuple[int, bool, int]]] = [[] for _ in range(queries)]

    def threshold(self, q: int) -> int:
        """The least score that can be among the best; what equals it may win by its id."""
        return -self.found[q][-1][0] if len(self.found[q]) == self.k else 1

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray, has: np.ndarray) -> None:
        order = np.lexsort((ids, ~has, -scores))[: self.k]
        more = [(-int(scores[o]), not has[o], int(ids[o])) for o in order]
        self.found[q] = sorted(self.found[q] + more)[: self.k]


def max_score(lists: list[tuple[int, np.ndarray, np.ndarray]], size: int, k: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents that score threshold or more and may be among the k best.

    lists: for each term the upper bound, the places of its documents in rising order, their contributions (1 or more).
    """
    lists = sorted(lists, key=lambda x: -x[0])
    rest = sum(bound for bound, _, _ in lists)
    scores = np.zeros(size, np.int64)
    at = 0
    while at < len(lists) and rest >= threshold:  # essential: a document that no list has had so far could still reach it
        bound, places, each = lists[at]
        scores[places] += each
        rest -= bound
        at += 1
        if at < len(lists) and size > k:
            threshold = max(threshold, int(np.partition(scores, size - k)[size - k]))
    asked = np.flatnonzero((scores > 0) & (scores + rest >= threshold))
    told = scores[asked]
    for bound, places, each in lists[at:]:  # non-essential: only who can still qualify is looked up
        if not len(asked):
            break
        spot = np.minimum(np.searchsorted(places, asked), len(places) - 1)
        told = told + np.where(places[spot] == asked, each[spot], 0)
        rest -= bound
        if len(told) > k:
            threshold = max(threshold, int(np.partition(told, len(told) - k)[len(told) - k]))
        stay = told + rest >= threshold
        asked, told = asked[stay], told[stay]
    good = told >= threshold
    return asked[good], told[good]


def _searched(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, asked, weight, documents, terms_in_all = held.value
        best = _Best(len(items), k)
        for batch in batches:
            for r in range(batch.num_rows):
                raw = {n: np.frombuffer(batch.column(n)[r].as_buffer(), t) for n, t in (("doc_ids", np.int64), ("has_id", bool), ("lengths", np.int64), ("places", np.int32), ("counts", np.int64))}
                terms, often = (batch.column(n)[r].values.to_numpy() for n in ("terms", "frequencies"))
                m = 100 - 90 + (90 * raw["lengths"] * documents) // terms_in_all
                share = (1_000_000_000 * raw["counts"]) // (1000 * raw["counts"] + 8 * m[raw["places"]])
                ends = np.cumsum(often)
                each = share * np.repeat(weight[terms], often)
                bounds = np.maximum.reduceat(each, ends - often) if len(terms) else each
                spot = np.full(len(weight), -1, np.int64)
                spot[terms] = np.arange(len(terms))
                for q, wanted in enumerate(asked):
                    here = spot[wanted]
                    here = here[here >= 0]
                    here = here[bounds[here] > 0]
                    if not len(here):
                        continue
                    lists = [(int(bounds[t]), raw["places"][ends[t] - often[t] : ends[t]], each[ends[t] - often[t] : ends[t]]) for t in here]
                    places, scores = max_score(lists, len(m), k, best.threshold(q))
                    if len(places):
                        best.add(q, scores, raw["doc_ids"][places], raw["has_id"][places])
        for q, found in enumerate(best.found):
            if found:
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([items[q]] * len(found), pa.int64()), "doc_id": pa.array([None if gone else i for _, gone, i in found], pa.int64()), "score": pa.array([-s for s, _, _ in found], pa.int64())})

    return run


def term_weights(frequencies: list[int], documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * f + 1))) for f in frequencies], np.int64)


def _block_answers(docs: DataFrame, block: DataFrame, k: int, **shard_bounds: int) -> DataFrame:
    """block: item_id, terms (all distinct terms of an item). item_id, doc_id, score: k rows for each item and task at most."""
    spark = docs.sparkSession
    asked = block.collect()
    terms = sorted({t for r in asked for t in r.terms})
    number = {t: i for i, t in enumerate(terms)}
    shards = build_shards(docs, [bytes(t) for t in terms], **shard_bounds)
    totals = shards.agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms_in_all"), F.lit(0)).alias("all")).first()
    each = shards.select(F.explode(F.arrays_zip("terms", "frequencies")).alias("t")).select("t.*")
    often = [0] * len(terms)
    for r in each.groupBy("terms").agg(F.sum("frequencies").alias("df")).collect():  # a row for each term of the block at most
        often[r.terms] = r.df
    lists = [np.array([number[t] for t in r.terms], np.int64) for r in asked]
    held = spark.sparkContext.broadcast(([r.item_id for r in asked], lists, term_weights(often, totals.n), totals.n, max(1, totals["all"])))
    found = shards.where("size(terms) > 0").select("doc_ids", "has_id", "lengths", "terms", "frequencies", "places", "counts")
    out = stored(found.mapInArrow(_searched(held, k), "item_id long, doc_id long, score long").withColumn("task", F.spark_partition_id() % MERGE_GROUPS), "answers")
    discard(shards)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, block_terms: int = BLOCK_TERMS, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. The k highest-scoring documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    use_small_arrow_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    terms = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_item_terms, "item_id long, term binary")
    terms = stored(terms.distinct(), "terms")
    blocks = max(1, -(-terms.select("term").distinct().count() // block_terms))
    asked = stored(terms.groupBy("item_id").agg(F.collect_list("term").alias("terms")).withColumn("block", F.pmod(F.xxhash64(F.lit(7), "item_id"), F.lit(blocks))), "asked")
    each = [_block_answers(rows, asked.where(F.col("block") == b).select("item_id", "terms"), k, shard_docs=shard_docs, shard_postings=shard_postings) for b in range(blocks)]
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    first = reduce(DataFrame.unionByName, each).withColumn("r", F.row_number().over(W.partitionBy("item_id", "task").orderBy(*order))).where(F.col("r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
