"""Mixing sources to target weights: every source gives its share of the words, documents drawn at random.

A document's key is a digest of its id, so keys are spread evenly and in random order. A source is sorted by key in
ranges: a range's words are summed by partial aggregation, prefix sums over the ranges say where each begins, and the
source's budget says which of them are taken whole, which not, and in which single range the cut lies. Only that range
is sorted row by row, so a source of any size is cut at its exact budget while some RANGE_ROWS rows of it meet in a task.
A budget above the source's size takes all of it as often as it fits, and cuts in the epoch after.

Targets: the sources, in order of code points and null last, weigh weights[0], weights[1], ..., again and again, and share
all words by weight. None gets more than most times its own words: what is above is shared again among the others by
weight, in rounds of aggregates over the table of sources, until none is above.

Bounds: a row per source is stored, numbered by ranges, and joined through `join_on_counted_key`; the driver sees sums.

Defined cases: a null text has no words; sources without words get nothing; a null source is a source of its own; equal
keys (rows with one doc_id) are ordered by size, so rows that differ in nothing are interchangeable; a null doc_id is
drawn as the empty id; a very long text is counted where it is read and doesn't travel, and one document may be cut
anywhere; an empty table gives no rows. Other columns are ignored by `mix_plan` and kept by `mixed_texts`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm._common import join_on_counted_key, stored

WORDS = r"[^\x20\x09-\x0D]+"
#: A word with the white space before it.
HEADS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
#: Rows of all sources in a range of keys, about.
RANGE_ROWS = 50_000
#: Keys are numbers of so many hex digits of the digest.
KEY_DIGITS = 15


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def random_key(seed: int, doc_id: Column) -> Column:
    """A number below 16 ** KEY_DIGITS, the same each time."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(drawn, 1, KEY_DIGITS), 16, 10).cast("long")


def sources_in_order(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """name, source, words, n_rows and place (from 0, by code point, null last): a row per source, sorted in ranges."""
    each = rows.groupBy("name").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("n_rows"))
    each = stored(each, "sources")
    tasks = max(1, each.count() // range_rows)
    order = [F.col("source").asc_nulls_last()]
    dealt = stored(each.repartitionByRange(tasks, *order).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("k"))  # a row for range_rows sources
    before = F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("part", before.alias("start")))
    numbered = dealt.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1).join(starts, "part")
    return numbered.select("name", "source", "words", "n_rows", (F.col("r") + F.col("start")).alias("place"))


def with_targets(sources: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """sources: name, words, n_rows, place. Adds target: shares by weight, none above most times its words."""
    cycle = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights))
    rows = stored(sources.withColumn("weight", cycle).withColumn("cap", (F.col("words") * most).cast("double")), "weighed")
    total = float(rows.agg(F.sum("words").alias("t")).first().t or 0)
    capped = F.lit(False)
    while True:  # the share of a unit of weight rises from round to round, so what is capped stays so
        seen = rows.agg(F.count_if(capped).alias("n"), F.sum(F.when(capped, F.col("cap"))).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        left, open_weight = total - (seen.held or 0.0), seen.open or 0.0
        above = capped | (F.col("cap") * open_weight < F.col("weight") * left)
        if not open_weight or rows.where(above).count() == seen.n:
            break
        capped = above
    target = F.when(capped, F.col("cap")).otherwise(F.col("weight") * left / open_weight) if open_weight else F.col("cap")
    return rows.select("name", "words", "n_rows", target.alias("target"))


def mix_plan(docs: DataFrame, *, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 42, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs (times that it is taken whole), taken (words in all)."""
    name = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), F.col("source")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = stored(rows.select("doc_id", "source", "size", random_key(seed, F.col("doc_id")).alias("key"), name.alias("name")), "sizes")
    total = rows.count()
    plan = with_targets(sources_in_order(rows, range_rows), weights, most)
    budget = F.round("target").cast("long")
    plan = plan.withColumn("full", F.when(F.col("words") > 0, F.floor(budget / F.greatest("words", F.lit(1)))).otherwise(0).cast("long"))
    plan = stored(plan.withColumn("rest", budget - F.col("full") * F.col("words")), "plan")
    # where each source's rest ends: prefix sums over its ranges
    width = max(1, 16**KEY_DIGITS // max(1, -(-total // range_rows)))
    ranged = rows.withColumn("range", F.floor(F.col("key") / F.lit(width)).cast("long"))
    sums = ranged.groupBy("name", "range").agg(F.sum("size").alias("words_here"))
    before = F.coalesce(F.sum("words_here").over(W.partitionBy("name").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = sums.select("name", "range", "words_here", before.alias("before")).join(plan.select("name", "rest"), "name")
    cut = placed.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words_here")))
    cuts = plan.join(cut.select("name", F.col("range").alias("cut"), "before"), "name", "left")  # no cut: nothing is left over, or the source has no words
    told = join_on_counted_key(ranged, stored(cuts.select("name", "words", "n_rows", "target", "full", "rest", "cut", "before"), "cuts"), "name", "n_rows", total)
    told = stored(told.withColumn("inside", F.coalesce(F.col("range") == F.col("cut"), F.lit(False))), "told")
    whole = F.when(F.col("range") < F.col("cut"), F.col("size")).otherwise(F.lit(0))
    outside = told.where(~F.col("inside")).withColumn("part_taken", whole.cast("long"))
    upto = F.col("before") + F.coalesce(F.sum("size").over(W.partitionBy("name").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = told.where("inside").withColumn("part_taken", F.least(F.greatest(F.col("rest") - upto, F.lit(0)), F.col("size")).cast("long"))
    both = outside.unionByName(inside)
    epochs = F.when(F.col("size") > 0, F.col("full") + (F.col("part_taken") == F.col("size")).cast("long")).otherwise(F.lit(0)).cast("long")
    return both.select("doc_id", "source", "size", F.col("words").cast("long").alias("source_size"), "target", epochs.alias("epochs"), (F.col("full") * F.col("size") + F.col("part_taken")).alias("taken"))


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: a row for each time that a document is taken, with all its columns, its text cut at the budget where it ends there, and epoch.

    doc_id must be unique and not null; documents that aren't taken have no row; a column named epoch gives way.
    """
    plan = mix_plan(docs, **how).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    rows = docs.join(plan, F.col("doc_id") == F.col("__id"))
    each = rows.withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("__taken") - 1) / F.col("__size")))))
    words = F.least(F.col("__size"), F.col("__taken") - F.col("__epoch") * F.col("__size"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(HEADS), F.lit(0)), F.lit(1), words.cast("int")), "")
    cut = F.when(words < F.col("__size"), head).otherwise(F.col("text"))
    return each.withColumn("text", cut).select(*[c for c in docs.columns if c != "epoch"], F.col("__epoch").alias("epoch"))
