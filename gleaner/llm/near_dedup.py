"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct word shingles, as 64-bit hashes. One permutation scatters the set, a second one,
circularly shifted by 0, 1, 2, ..., yields all COORDINATES of the signature. Signatures are cut into BANDS bands of
ROWS coordinates; a pair at a similarity of 0.8 shares no band with a chance of (1 - 0.8^4)^32 = 5e-8.

Documents with equal sets are one representative first. A bucket's members are not paired with each other. First
every member meets HUBS others at most: the heads of its buckets (members that meet most others) that it shares most
buckets with. Those pairs are verified on full sets, and components of the verified links make families. Then buckets
that still span several families are searched by signature, every member outside the largest family against all:
small buckets whole, large ones in blocks of BLOCK rows and CELLS shingles at most. A pair meets in the first band only
that both share. What this search allows (six standard errors below the threshold) and is in another family, a member
asks: its LIKELIEST partner in a group, on full sets. Where a member has more allowed partners, the groups are searched
once more with the families of then, and whoever is still apart meets there, full sets against full sets in one task,
without a row for a pair. So no link is lost to a bucket's size, and rows stay near the number of members times the
bands that they share, also of documents that share much but less than the threshold: these are compared, never written
as pairs.

Nothing unbounded reaches the driver or one task: buckets are counted by partial aggregation, a partner that very many
members ask is dealt in parts, full sets of two rows at a time are intersected by a built-in function.

Defined cases: without words or text the set is empty and linked with nothing; with fewer words than a shingle, the
whole sequence is the one shingle; a very long text is one row, its set 8 bytes a shingle. A row without doc_id is
linked with nothing, has no component and is kept. Rows with the same doc_id are one vertex. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._common import join_on_counted_key, kept, scratch, stored, use_small_arrow_batches
from gleaner.operators.components import connected_components

ROWS, BANDS = 4, 32
COORDINATES = ROWS * BANDS
#: Members of a bucket that are searched in one group, at most, and shingles of all of them together, if a member hasn't more.
BLOCK = 4_096
CELLS = 1 << 23
#: Rows of one search task by signature, and by full sets, about.
PACK = 4_096
SET_PACK = 1_024
#: Partners of a member in the first round, and members that meet one copy of a much asked partner.
HUBS = 2
#: Buckets that a member shares with a hub at least.
HUB_BUCKETS = 2
PART = 1_024
#: Partners that a member asks one by one in each group; if more are allowed, the group is searched again on full sets.
LIKELIEST = 1
CACHE_WORDS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of so many words, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix64(out * _P + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima: the first permutation scatters the set, the second is shifted by one each time."""
    scattered = (mix64(shingles + _P) >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    shifts = np.arange(COORDINATES, dtype=np.uint32)[:, None]
    for a in range(0, len(scattered), 512):
        z = scattered[None, a : a + 512] - shifts
        z ^= z >> np.uint32(16)
        z *= np.uint32(0x7FEB352D)
        z ^= z >> np.uint32(15)
        z *= np.uint32(0x846CA68B)
        z ^= z >> np.uint32(16)
        np.minimum(out, z.min(axis=1), out=out)
    return out


def _signed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, width)
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "set_key", "signature"])

    return run


def band_keys(sig: np.ndarray) -> np.ndarray:
    """For each signature the keys of its bands."""
    parts = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * _P + parts[:, :, r])
    return key.astype(np.int64)


def _signatures(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            key, band = band_keys(_signatures(batch)), np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(band), pa.array(np.repeat(batch.column("rep").to_numpy(), BANDS))], names=["bucket", "band", "rep"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width).astype(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(found, pa.list_(pa.int64()))], names=["rep", "shingles"])

    return run


def least_agreement(percent: int) -> int:
    """Coordinates that a linked pair shares at least, but for a chance of about 1e-9: six standard errors below the mean."""
    p = percent / 100
    return int(max(0.0, p - 6 * (p * (1 - p) / COORDINATES) ** 0.5) * COORDINATES)


def hub_pairs(members: DataFrame, total: int) -> DataFrame:
    """members: bucket, rep, n (of the bucket). Pairs (a, b): each member with HUBS heads of its buckets, at most."""
    meets = members.groupBy("rep").agg(F.sum("n").alias("meets"), F.collect_list(F.struct("bucket", "n")).alias("of"))  # BANDS entries at most
    each = meets.select("rep", "meets", F.explode("of").alias("o")).select("rep", "meets", "o.*")
    heads = each.groupBy("bucket").agg(F.max(F.struct("meets", (-F.col("rep")).alias("minus"))).alias("h"), F.first("n").alias("n")).select("bucket", (-F.col("h.minus")).alias("head"), "n")
    asked = join_on_counted_key(members.select("bucket", "rep"), heads, "bucket", "n", total).where("head != rep")
    every = asked.groupBy("rep").agg(F.collect_list("head").alias("heads"))
    liked = F.array_sort(F.transform(F.array_distinct("heads"), lambda h: F.struct((-F.size(F.filter("heads", lambda x: x == h))).alias("k"), h.alias("h"))))
    return every.select(F.explode(F.slice(liked, 1, HUBS)).alias("l"), F.col("rep").alias("b")).where(F.col("l.k") <= -HUB_BUCKETS).select(F.col("l.h").alias("a"), "b")


def with_sides(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with a's and b's value (va, vb) of a table (rep, value). An a of very many pairs is copied for parts of them.

    A b is expected in few pairs.
    """
    often = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n_asked"))
    total = pairs.count()
    dealt = join_on_counted_key(pairs.select("a", "b"), often, "a", "n_asked", max(1, total)).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n_asked") / PART)).cast("int").alias("part"))
    left = often.join(table, F.col("a") == F.col("rep")).select("a", F.col(value).alias("va"), F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_asked") / PART).cast("int") - 1)).alias("part"))
    return dealt.join(left, ["a", "part"]).join(table.select(F.col("rep").alias("b"), F.col(value).alias("vb")), "b").select("a", "b", "va", "vb")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity; sets: rep, shingles."""
    both = with_sides(pairs, sets, "shingles").withColumn("k", F.size(F.array_intersect("va", "vb")))
    return both.where(100 * F.col("k") >= percent * (F.size("va") + F.size("vb") - F.col("k"))).select("a", "b").distinct()


def _groups(table: pa.Table) -> Iterator[np.ndarray]:
    group = table["group"].to_numpy()
    order = np.argsort(group, kind="stable")
    yield from np.split(order, np.flatnonzero(np.diff(group[order])) + 1)


def _asking(percent: int):
    """Of each group: every asking row b with its likeliest partners a of other families; once more, without a, if it has more of them."""
    least = least_agreement(percent)

    def run(table: pa.Table) -> pa.Table:
        rep, family, n, band = (table[c].to_numpy() for c in ("rep", "family", "n_shingles", "band"))
        asks, sig = table["asks"].to_numpy(zero_copy_only=False).astype(bool), _signatures(table)
        keys = band_keys(sig)
        a, b = [], []
        for some in _groups(table):
            for i in some[asks[some]]:
                fit = some[(family[some] != family[i]) & (100 * np.minimum(n[some], n[i]) >= percent * np.maximum(n[some], n[i]))]
                fit = fit[(keys[fit] == keys[i]).argmax(axis=1) == band[i]]  # a pair meets in the first band that it shares
                agree = (sig[fit] == sig[i]).sum(axis=1)
                fit, agree = fit[agree >= least], agree[agree >= least]
                first = rep[fit[np.lexsort((rep[fit], -agree))][:LIKELIEST]].tolist() + [None] * (len(fit) > LIKELIEST)
                a += first
                b += [int(rep[i])] * len(first)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _meeting(percent: int):
    """Links on full sets of each group's asking rows with rows of other families, where one of both has more to ask: a spanning part of them."""
    least = least_agreement(percent)

    def run(table: pa.Table) -> pa.Table:
        rep, family, band = (table[c].to_numpy() for c in ("rep", "family", "band"))
        asks, more = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "more"))
        sig, shingles = _signatures(table), table["shingles"].combine_chunks()
        keys = band_keys(sig)
        n = shingles.value_lengths().to_numpy().astype(np.int64)  # rows with the same doc_id differ in it
        cells, starts = shingles.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n)])
        a, b = [], []
        for some in _groups(table):
            merged = family.copy()
            for i in some[asks[some]]:
                once = ~asks[some] | (rep[some] > rep[i])  # of two that ask, one does
                fit = some[once & (merged[some] != merged[i]) & (more[some] | more[i]) & (100 * np.minimum(n[some], n[i]) >= percent * np.maximum(n[some], n[i]))]
                fit = fit[(keys[fit] == keys[i]).argmax(axis=1) == band[i]]
                fit = fit[(sig[fit] == sig[i]).sum(axis=1) >= least]
                if not len(fit):
                    continue
                own = np.sort(cells[starts[i] : starts[i + 1]])
                theirs = np.concatenate([cells[starts[j] : starts[j + 1]] for j in fit])
                hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(n[fit])[:-1]]))
                for j in fit[100 * both >= percent * (n[fit] + n[i] - both)]:
                    if merged[j] != merged[i]:
                        a.append(int(rep[j])), b.append(int(rep[i]))
                        merged[some[merged[some] == merged[j]]] = merged[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def search_groups(rows: DataFrame, block: int = BLOCK, cells: int = CELLS) -> DataFrame:
    """rows: bucket, band, rep, family, n_shingles, signature. The groups to search: group, band, asks, rep, family, n_shingles, signature.

    Buckets of one family go. Every member outside a bucket's largest family asks all others of the bucket: of a large
    bucket in blocks, so that a member meets all blocks of others, and another all blocks of members.
    """
    size = F.sum("n_shingles")
    parts = rows.groupBy("bucket", "family").agg(F.count(F.lit(1)).alias("k"), size.alias("cells"))
    many = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("n"), F.sum("cells").alias("cells"), F.max(F.struct("k", "family", "cells")).alias("main")).where("parts > 1")
    blocks_of = lambda n, c: F.greatest(F.ceil(n / block), F.ceil(c / cells)).cast("int")
    others, other_cells = F.col("n") - F.col("main.k"), F.col("cells") - F.col("main.cells")
    many = many.select("bucket", "n", F.col("main.family").alias("main"), blocks_of(F.col("n"), F.col("cells")).alias("mb"), blocks_of(others, other_cells).alias("rb"))
    placed = stored(join_on_counted_key(rows, many, "bucket", "n", max(1, rows.count()), "inner"), "open")
    names = ["rep", "family", "n_shingles", "signature"]
    asks = F.col("family") != F.col("main")
    out = placed.where("mb = 1").select(F.col("bucket").alias("group"), "band", asks.alias("asks"), *names)
    large = placed.where("mb > 1").withColumn("deal", F.xxhash64("rep"))
    member = large.select("bucket", "band", *names, F.pmod("deal", "mb").alias("m"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("r"), F.lit(False).alias("asks"))
    other = large.where(asks).select("bucket", "band", *names, F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod("deal", "rb").alias("r"), F.lit(True).alias("asks"))
    blocks = member.unionByName(other).select(F.xxhash64("bucket", "m", "r").alias("group"), "band", "asks", *names)
    return out.unionByName(blocks)


def verified_links(members: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, total: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that have the same components as all pairs that share a bucket and reach the similarity."""

    def open_groups(links: DataFrame) -> DataFrame:
        found = connected_components(links)
        # a bucket of one family is done; signatures travel for the others alone
        placed = stored(members.join(found, F.col("rep") == F.col("node"), "left").select("bucket", "band", "rep", "n", F.coalesce("component", "rep").alias("family")), "placed")
        spans = placed.groupBy("bucket").agg((F.min("family") != F.max("family")).alias("open"), F.first("n").alias("n_of")).where("open").select("bucket", "n_of")
        opened = join_on_counted_key(placed, spans, "bucket", "n_of", total, "inner").select("bucket", "band", "rep", "family")
        rows = opened.join(reps.select("rep", "n_shingles", "signature"), "rep").select("bucket", "band", "rep", "family", "n_shingles", "signature")
        return stored(search_groups(stored(rows, "rows"), block), "groups")

    def in_packs(groups: DataFrame, rows: int, cells: int | None = None):
        """Groups dealt into tasks of about so many rows, and shingles if these travel."""
        seen = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("cells")).first()
        packs = max(1, -(-seen.n // rows), -(-seen.cells // cells) if cells else 1)
        return groups.groupBy(F.pmod(F.xxhash64("group"), F.lit(packs)))

    links = stored(linked(hub_pairs(members, total), sets, percent), "links")
    groups = open_groups(links)
    told = stored(in_packs(groups, PACK).applyInArrow(_asking(percent), "a long, b long"), "told")
    pairs = stored(told.where("a IS NOT NULL").distinct(), "pairs")
    links = stored(links.unionByName(linked(pairs, sets, percent)), "links")
    unsure = stored(told.where("a IS NULL").select(F.col("b").alias("rep")).distinct(), "unsure")
    if not unsure.limit(1).collect():
        return links
    groups = open_groups(links).join(unsure.withColumn("more", F.lit(True)), "rep", "left").withColumn("more", F.coalesce("more", F.lit(False)))
    wanted = groups.where("more").groupBy("group").agg(F.count(F.lit(1)).alias("n_more"))
    groups = stored(join_on_counted_key(groups, wanted, "group", "n_more", max(1, groups.count()), "inner").drop("n_more"), "unsure_groups")
    met = in_packs(stored(groups.join(sets, "rep"), "with_sets"), SET_PACK, CELLS).applyInArrow(_meeting(percent), "a long, b long")
    return stored(links.unionByName(met), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    width: words of a shingle; percent: the least similarity of linked documents, in hundredths; block: members of a search group, at most.
    """
    spark = docs.sparkSession
    use_small_arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark):
        signed = stored(texts.mapInArrow(_signed(width), "doc_id long, n_shingles long, set_key binary, signature binary"), "signed")
        having = signed.where("n_shingles > 0 and doc_id is not null")
        reps = stored(having.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "reps")
        total = max(1, BANDS * reps.count())
        bands = reps.select("rep", "signature").mapInArrow(_banded, "bucket long, band int, rep long")
        buckets = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = stored(join_on_counted_key(bands, buckets, "bucket", "n", total, "inner").dropDuplicates(["bucket", "rep"]), "members")
        # the only shuffle of texts; which plan it takes doesn't hang on the size of either side
        met = members.select("rep").distinct()
        held = met.join(texts.hint("merge"), F.col("rep") == F.col("doc_id")).select("rep", "text")
        sets = stored(held.mapInArrow(_sets(width), "rep long, shingles array<long>").where(F.size("shingles") > 0), "sets")
        components = connected_components(verified_links(members, reps, sets, percent, total, block))
        of_set = reps.join(components, F.col("rep") == F.col("node"), "left").select("set_key", "copies", F.coalesce("component", "rep").alias("component"))
        named = join_on_counted_key(signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")), of_set, "set_key", "copies", max(1, signed.count()))
        component = F.coalesce("component", "doc_id")
        return kept(named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), "near_duplicates")


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, with all their columns: one of each component, the smallest doc_id."""
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
