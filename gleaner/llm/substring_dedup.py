"""Substring deduplication with a log-structured fingerprint index.

A window is WINDOW consecutive words. Its fingerprint is the smallest hash among its GRAM-word grams, so equal
windows have equal fingerprints and a document has about one for five words. `FingerprintIndex.add` takes in a batch
of documents: every text is read once, and two immutable tables in the shared folder, bucketed and sorted by
fingerprint, are written: the postings (fingerprint, doc_id, age) and a run (fingerprint, documents). The new run is
merge-joined with the live runs of earlier batches - bucket by bucket, without a shuffle - which tells the
fingerprints that occur before. Beyond MAX_RUNS live runs, they are merged into one before the next batch.

`FingerprintIndex.clean` verifies what fingerprints only suggest, for any batches against all earlier ones, on all
words, by keys of 96 bits apart from the fingerprint. Neighbouring windows of one fingerprint are a segment. Documents
that share a fingerprint send their segments' keys and places, and all but the first document with a segment lose it.
Where a fingerprint has different segments, the first document of each sends its windows' keys, from every place at
which it has the segment, and a window is removed where its key starts in an earlier document. Earlier is: in an earlier batch, or in the same one with a
smaller doc_id. The keys come from 64-bit hashes of words: two words of one hash would count as equal, which among a
billion different words has a chance of 3 %, and then matters to windows alone that are equal elsewhere.

Documents with equal words are one: the first stands for all, the others lose every word if they have WINDOW words or
more. Fingerprints in more than HOT_SHARE of a batch's documents (by a part of them; there are few) count as shared
without being looked up, so their postings, a third of all documents maybe, go to no bucket. Keys that very many
documents share are counted by partial aggregation and joined through `join_on_counted_key`.

Defined cases: a null text has no words; documents below WINDOW words lose none; a null doc_id is smaller than none,
its row loses nothing and causes no removal; rows with the same doc_id don't remove each other's words; an empty
table gives no rows; a very long text is one row of a batch bounded by bytes; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm._common import discard, join_on_counted_key, kept, remove_folder, scratch, scratch_dir, stored, use_small_arrow_batches

WINDOW = 13
GRAM = 5
MAX_RUNS = 4
BATCHES = 3
#: Postings of a bucket, about, and bytes of text that give one posting.
BUCKET_ROWS = 1_000_000
POSTING_BYTES = 20
#: A fingerprint is hot beyond this share of a batch's documents; so many are treated so, at most.
HOT_SHARE = 0.01
MAX_HOT = 10_000
HOT_SAMPLE = 16
#: Bytes of text whose words are hashed at a time, about, and the longest word that is hashed by sums.
HASH_BYTES = 1 << 20
LONG_WORD = 256
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_CODES = np.random.default_rng(42).integers(0, 1 << 64, 256, dtype=np.uint64)
_CODES[_BLANK] = 0


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[bytes]:
    """Runs of signs other than space, tab, newline, vertical tab, form feed and carriage return."""
    return _bytes_of(text).split()


def _power(x: np.uint64, k: int) -> np.uint64:
    return np.uint64(pow(int(x), k, 1 << 64))


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _next(x: np.ndarray, fx: np.uint64, y: np.ndarray, at: int) -> np.ndarray:
    """Hashes of runs, from those of their first part x and of their second part y, which begins so many words later."""
    n = len(y) - at
    return x[:n] * fx + y[at:]


@functools.lru_cache(maxsize=4)
def _powers(doublings: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse, 1 first."""
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full((1 << doublings) - 1, x)])) for x in (_P, inverse))


def _piece_hashes(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, in sums over the texts' bytes, and the number of words of each text."""
    if len(texts) == 1 and len(texts[0]) > 2 * HASH_BYTES:
        words = texts[0].split()
        step = HASH_BYTES // LONG_WORD  # long words are named by one sign, and hashed after that
        told = [_piece_hashes([b" ".join([w if len(w) <= LONG_WORD else b"-" for w in words[i : i + step]])])[0] for i in range(0, len(words), step)]
        h = np.concatenate([np.zeros(0, np.uint64), *told])
        for i in [i for i, w in enumerate(words) if len(w) > LONG_WORD]:
            h[i] = xxhash.xxh3_64_intdigest(words[i])
        return h, np.array([len(words)])
    data = b" ".join([b"", *texts, b""])
    signs = np.frombuffer(data, np.uint8)
    up, down = _powers(max(20, (len(data) - 1).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[signs] * up[: len(data)])])
    blank = _BLANK[signs]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1  # the text begins and ends with a blank
    starts, ends = edges[::2], edges[1::2]
    h = _scramble((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _Q)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():  # sums modulo 2^64 are weak for long runs of a pattern
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    begin = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return h, np.diff(np.searchsorted(starts, begin))


def word_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of words of each text."""
    each = [_bytes_of(t) for t in texts]
    n = np.array([len(t) for t in each], np.int64)
    of, huge = (np.cumsum(n) - n) // HASH_BYTES, n > HASH_BYTES  # the piece in which a text begins; a huge one is its own
    cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | huge[1:] | huge[:-1]) + 1).tolist(), len(each)] if each else [0]
    told = [_piece_hashes(each[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    hashes, sizes = [np.zeros(0, np.uint64), *[h for h, _ in told]], [np.zeros(0, np.int64), *[n for _, n in told]]
    return np.concatenate(hashes), np.concatenate(sizes)


class Windows:
    """The windows of several runs of words, given by the words' hashes, and their segments: neighbouring windows of one run and fingerprint."""

    def __init__(self, h: np.ndarray, sizes: np.ndarray, keys: bool = True):
        total = len(h)
        of = np.repeat(np.arange(len(sizes)), sizes)
        self.position = np.flatnonzero(of[: max(0, total - WINDOW + 1)] == of[WINDOW - 1 :]) if total >= WINDOW else np.zeros(0, np.int64)
        self.list = of[self.position]
        self.place = self.position - (np.cumsum(sizes) - sizes)[self.list]  # a window's first word in its list
        if not len(self.position):
            self.fingerprint = self.a = self.b = np.zeros(0, np.uint64)
            self.starts = self.lengths = np.zeros(0, np.int64)
            return
        p2, p4 = _power(_P, 2), _power(_P, 4)
        two = _next(h, _P, h, 1)
        four = _next(two, p2, two, 2)
        grams = _scramble(_next(four, _P, h, 4))
        m = np.minimum(grams[:-1], grams[1:])
        m = np.minimum(m[:-2], m[2:])
        m = np.minimum(m[:-4], m[4:])
        self.fingerprint = np.minimum(m[: len(grams) - 8], grams[8:])[self.position]  # the smallest of nine grams
        change = (self.fingerprint[1:] != self.fingerprint[:-1]) | (self.list[1:] != self.list[:-1])
        self.starts = np.flatnonzero(np.concatenate([[True], change]))
        self.lengths = np.diff(np.concatenate([self.starts, [len(self.position)]]))
        if keys:
            q2, q4 = _power(_Q, 2), _power(_Q, 4)
            other = _next(h, _Q, h, 1)
            other_four = _next(other, q2, other, 2)
            self.a, self.b = (_scramble(self._thirteen(h, f, x, x4)[self.position]) for f, x, x4 in ((_P, four, p4), (_Q, other_four, q4)))

    @staticmethod
    def _thirteen(h: np.ndarray, f: np.uint64, four: np.ndarray, f4: np.uint64) -> np.ndarray:
        eight = _next(four, f4, four, 4)
        return _next(_next(eight, f4, four, 8), f, h, 12)

    def segment_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each segment, from its windows and their places in it."""
        place = (np.arange(len(self.a)) - np.repeat(self.starts, self.lengths)).astype(np.uint64) * _Q
        a, b = (_scramble(np.add.reduceat(_scramble(x + place), self.starts)) if len(x) else x for x in (self.a, self.b))
        return a.astype(np.int64), (b >> np.uint64(32)).astype(np.uint32).astype(np.int32)

    def window_keys(self) -> tuple[np.ndarray, np.ndarray]:
        return self.a.astype(np.int64), (self.b >> np.uint64(32)).astype(np.uint32).astype(np.int32)


assert WINDOW == 13 and GRAM == 5  # what the sums of Windows are made for


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        h, sizes = word_hashes(texts)
        w = Windows(h, sizes, keys=False)
        of, found = w.list[w.starts], w.fingerprint[w.starts]
        order = np.lexsort((found, of))
        of, found = of[order], found[order]
        once = np.concatenate([[True], (of[1:] != of[:-1]) | (found[1:] != found[:-1])]) if len(of) else np.zeros(0, bool)
        edges = np.concatenate([[0], np.cumsum(np.bincount(of[once], minlength=len(texts)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([hashlib.sha256(b" ".join(words_of(t))).digest() for t in texts], pa.binary()), pa.ListArray.from_arrays(pa.array(edges), pa.array(found[once].astype(np.int64)))],
            names=["doc_id", "n_words", "words_sha", "fingerprints"],
        )


#: Where a text is: its document, and its batch with 32 bits of the text, which tell rows with the same doc_id apart.
PLACE = ["doc_id", "tag"]


def _packed(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """Two numbers of 31 bits in one; spans are packed so, first window and number of windows."""
    return pa.array(high.astype(np.int64) << 32 | low.astype(np.int64))


def _mixed(of: np.ndarray, value: np.ndarray) -> np.ndarray:
    return _scramble(value.astype(np.uint64) + of.astype(np.uint64) * _P)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments whose fingerprint is shared, with their keys and places."""
    for batch in batches:
        w = Windows(*word_hashes(batch.column("text").to_pylist()))
        of, found = w.list[w.starts], w.fingerprint[w.starts]
        shared = batch.column("shared")
        asked = _mixed(np.repeat(np.arange(batch.num_rows), shared.value_lengths().to_numpy()), shared.flatten().to_numpy(zero_copy_only=False))
        hit = np.flatnonzero(np.isin(_mixed(of, found), asked))
        a, b = w.segment_keys()
        at = pa.array(of[hit])
        columns = {c: batch.column(c).take(at) for c in PLACE}
        columns |= {"fingerprint": pa.array(found[hit].astype(np.int64)), "a": pa.array(a[hit]), "b": pa.array(b[hit]), "span": _packed(w.place[w.starts[hit]], w.lengths[hit])}
        yield pa.RecordBatch.from_pydict(columns)


def _ranges(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and lengths of each row of an array of spans."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    edges = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    for x, y in zip(edges, edges[1:], strict=False):
        yield flat[x:y] >> 32, flat[x:y] & 0xFFFFFFFF


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys and places of the windows of the asked segments."""
    for batch in batches:
        h, sizes = word_hashes(batch.column("text").to_pylist())
        parts, of, first = [h[:0]], [], []
        for k, (begin, (starts, lengths)) in enumerate(zip((np.cumsum(sizes) - sizes).tolist(), _ranges(batch.column("asked")), strict=True)):
            for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
                parts.append(h[begin + s : begin + s + n + WINDOW - 1]), of.append(k), first.append(s)
        w = Windows(np.concatenate(parts), np.array([len(p) for p in parts[1:]], np.int64))
        a, b = w.window_keys()
        columns = {c: batch.column(c).take(pa.array(np.array(of, np.int64)[w.list])) for c in PLACE}
        columns |= {"a": pa.array(a), "b": pa.array(b), "span": _packed(np.array(first, np.int64)[w.list] + w.place, np.ones(len(w.list), np.int64))}
        yield pa.RecordBatch.from_pydict(columns)


def kept_words(words: list[bytes], starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The words that none of these ranges of windows covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths + WINDOW - 1, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def _cut(with_text: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, out, sha = [], [], []
        for text, (starts, lengths) in zip(batch.column("text").to_pylist(), _ranges(batch.column("ranges")), strict=True):
            words = words_of(text)
            stay = kept_words(words, starts, lengths)
            removed.append(len(words) - len(stay)), out.append(b" ".join(stay)), sha.append(hashlib.sha256(b" ".join(words)).digest())
        columns = {c: batch.column(c) for c in PLACE} | {"words_sha": pa.array(sha, pa.binary()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())}
        if with_text:
            columns["kept_text"] = pa.array([x.decode("utf-8", "replace") for x in out], pa.string())
        yield pa.RecordBatch.from_pydict(columns)


class FingerprintIndex:
    """Runs and postings of all batches so far, in a folder that driver and executors share.

    The documents of the batches are read again to verify matches; they must stay readable.
    """

    def __init__(self, spark: SparkSession, buckets: int = 8):
        self.spark, self.buckets, self.folder = spark, buckets, scratch_dir(spark)
        self.runs: list[str] = []
        self.postings: list[tuple[str, int | None]] = []  # with the batch; merged ones tell it by a column
        self.hits: list[str] = []  # of each batch, as are the next two
        self.texts: list[DataFrame] = []
        self.signed: list[DataFrame] = []
        self.hot: set[int] = set()

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"gleaner_{kind}_{uuid.uuid4().hex}"
        df.write.bucketBy(self.buckets, "fingerprint").sortBy("fingerprint").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def _prints(self, values: set[int]) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame([(v,) for v in sorted(values)], "fingerprint long"))

    def add(self, docs: DataFrame) -> int:
        """Take in a batch (doc_id, text); its age, 0 for the first."""
        use_small_arrow_batches(self.spark)
        if len(self.runs) >= MAX_RUNS:
            self.compact()
        age = len(self.texts)
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        path = f"{self.folder}/signed_{age}"
        texts.mapInArrow(_signed, "doc_id long, n_words long, words_sha binary, fingerprints array<long>").write.parquet(path)
        signed = self.spark.read.parquet(path)
        each = signed.where(F.col("doc_id").isNotNull()).select(F.explode("fingerprints").alias("fingerprint"), "doc_id")
        part = signed.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(HOT_SAMPLE)) == 0)
        often = part.select(F.explode("fingerprints").alias("fingerprint")).groupBy("fingerprint").count().where(F.col("count") > max(50, HOT_SHARE * part.count()))
        hot = {r.fingerprint for r in often.orderBy(F.desc("count"), "fingerprint").limit(MAX_HOT).collect()}
        cold = each.join(self._prints(hot), "fingerprint", "left_anti") if hot else each
        postings = self._write(cold.repartition(self.buckets, "fingerprint"), "postings")
        run = self._write(self.spark.table(postings).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("documents")), "run")
        new = self.spark.table(run)
        known = [new.join(self.spark.table(r).select("fingerprint"), "fingerprint", "left_semi").select("fingerprint") for r in self.runs]  # merge joins
        known.append(new.where("documents > 1").select("fingerprint"))
        if self.hot:
            known.append(new.join(self._prints(self.hot), "fingerprint", "left_semi").select("fingerprint"))
        self.hits.append(self._write(functools.reduce(DataFrame.union, known).distinct(), "hits"))
        self.postings.append((postings, age))
        self.runs.append(run)
        self.texts.append(texts)
        self.signed.append(signed)
        self.hot |= hot
        return age

    def compact(self) -> None:
        """Merge all live runs into one, and their postings."""
        merged = self.spark.table(self.runs[0])
        for r in self.runs[1:]:
            other = self.spark.table(r).withColumnRenamed("documents", "more")
            merged = merged.join(other, "fingerprint", "full_outer").select("fingerprint", (F.coalesce("documents", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("documents"))
        run = self._write(merged, "run")
        postings = self._write(functools.reduce(DataFrame.union, self._posted()).repartition(self.buckets, "fingerprint"), "postings")
        for name in [*self.runs, *[p for p, _ in self.postings]]:
            self._drop(name)
        self.runs, self.postings = [run], [(postings, None)]

    def _posted(self) -> list[DataFrame]:
        each = [self.spark.table(p) if age is None else self.spark.table(p).withColumn("age", F.lit(age)) for p, age in self.postings]
        return [df.select("age", "doc_id", "fingerprint") for df in each]

    def clear(self) -> None:
        """Drop all tables and files."""
        for name in [*self.runs, *[p for p, _ in self.postings], *self.hits]:
            self.spark.sql(f"DROP TABLE {name}")
        remove_folder(self.spark, self.folder)
        self.runs, self.postings, self.hits, self.texts, self.signed = [], [], [], [], []

    def sharing(self, ages: Sequence[int]) -> DataFrame:
        """The documents of all batches with the fingerprints that they share with these ones: age, doc_id, shared."""
        wanted = self.spark.table(self.hits[ages[0]])
        if len(ages) > 1:
            every = functools.reduce(DataFrame.union, [self.spark.table(self.hits[k]) for k in ages])
            path = f"{self.folder}/wanted_{uuid.uuid4().hex}"
            name = f"gleaner_wanted_{uuid.uuid4().hex}"
            every.distinct().write.bucketBy(self.buckets, "fingerprint").sortBy("fingerprint").option("path", path).saveAsTable(name)
            wanted = self.spark.table(name)
            self.spark.sql(f"DROP TABLE {name}")  # its files stay
        parts = [p.join(wanted, "fingerprint", "left_semi").select("age", "doc_id", "fingerprint") for p in self._posted()]
        last = max(ages)
        if self.hot:
            for age, signed in enumerate(self.signed[: last + 1]):
                each = signed.where(F.col("doc_id").isNotNull()).select(F.lit(age).alias("age"), "doc_id", F.explode("fingerprints").alias("fingerprint"))
                parts.append(each.join(self._prints(self.hot), "fingerprint", "left_semi").select("age", "doc_id", "fingerprint"))
        return functools.reduce(DataFrame.union, parts).where(F.col("age") <= last).groupBy("age", "doc_id").agg(F.collect_set("fingerprint").alias("shared"))

    def clean(self, ages: Sequence[int], with_text: bool = False, last: bool = False) -> DataFrame:
        """One row per document of these batches: doc_id, n_words, n_removed, kept_sha256; with_text adds kept_text where words were removed.

        last: the index isn't needed any more; its files go as early as they can.
        """
        use_small_arrow_batches(self.spark)
        with scratch(self.spark):
            return kept(self._cleaned(sorted(ages), with_text, last), "cleaned")

    def _cleaned(self, ages: list[int], with_text: bool, last: bool) -> DataFrame:
        counted = stored(functools.reduce(DataFrame.union, [s.select(F.lit(age).alias("age"), "doc_id", "n_words", "words_sha") for age, s in enumerate(self.signed[: ages[-1] + 1])]), "counted")
        texts = functools.reduce(DataFrame.union, [t.select(F.lit(age).alias("age"), "doc_id", "text") for age, t in enumerate(self.texts[: ages[-1] + 1])])
        when = F.struct("age", "doc_id")
        originals = stored(counted.where("doc_id is not null").groupBy("words_sha").agg(F.min(when).alias("original"), F.count(F.lit(1)).alias("copies")), "originals")

        # texts with what they share are dealt once; those of copies stay away
        alone = originals.select(F.col("original.age").alias("age"), F.col("original.doc_id").alias("doc_id")).distinct()
        sharing = stored(self.sharing(ages).join(alone, ["age", "doc_id"], "left_semi"), "sharing")
        if last:
            self.clear()
        tag = F.shiftleft(F.col("age").cast("long"), 32) + F.xxhash64("text").bitwiseAND((1 << 32) - 1)
        suspects = stored(texts.hint("merge").join(sharing, ["age", "doc_id"]).select("doc_id", tag.alias("tag"), "text", "shared"), "suspects")
        discard(sharing)

        # whole segments first: all but the first document with a segment lose its windows
        segments = stored(suspects.mapInArrow(_segments, "doc_id long, tag long, fingerprint long, a long, b int, span long"), "segments")
        age = F.shiftright("tag", 32).alias("age")
        per_segment = stored(segments.groupBy("a", "b").agg(F.min(F.struct(age, "doc_id", "tag", "span")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("fingerprint").alias("fingerprint")), "per_segment")
        total = max(1, segments.count())

        def met(rows: DataFrame, firsts: DataFrame, total: int) -> DataFrame:
            """The rows whose key (a, b) is there more than once, and whether they are of a later document than the first one."""
            named = firsts.where("n > 1").select(F.struct("a", "b").alias("key"), F.col("first.age").alias("first_age"), F.col("first.doc_id").alias("first_id"), "n")
            asked = rows.withColumn("key", F.struct("a", "b")).drop("a", "b")
            is_later = F.struct(age, "doc_id") > F.struct("first_age", "first_id")
            return join_on_counted_key(asked, named, "key", "n", total, "inner").withColumn("later", is_later).drop("key", "first_age", "first_id", "n")

        judged = stored(met(segments, per_segment, total).where(~F.col("later") | age.isin(ages)), "judged")
        gone = judged.where("later").select(*PLACE, "span")
        discard(segments)
        # then single windows, where a fingerprint has different segments: each segment's first document speaks for all,
        # with all places at which it has the segment
        mixed = per_segment.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        speak = per_segment.where("n = 1").select("fingerprint", "first.doc_id", "first.tag", "first.span").unionByName(judged.where("NOT later").drop("later"))
        asked = join_on_counted_key(speak, mixed, "fingerprint", "m", total, "inner")
        asked = asked.groupBy(*PLACE).agg(F.collect_list("span").alias("asked"))
        keys = stored(suspects.select(*PLACE, "text").hint("merge").join(asked, PLACE).mapInArrow(_windows, "doc_id long, tag long, a long, b int, span long"), "keys")
        discard(per_segment)
        firsts = keys.groupBy("a", "b").agg(F.min(F.struct(age, "doc_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        repeated = met(keys.where(age.isin(ages)), firsts, max(1, keys.count())).where("later").select(*PLACE, "span")
        removed = stored(gone.union(repeated).groupBy(*PLACE).agg(F.collect_list("span").alias("ranges")), "removed")
        discard(judged, keys)
        schema = "doc_id long, tag long, words_sha binary, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
        cut = suspects.select(*PLACE, "text").hint("merge").join(removed, PLACE).mapInArrow(functools.partial(_cut, with_text), schema)

        # a row is found again by its words, in which rows with the same doc_id may differ
        named = join_on_counted_key(counted.where(F.col("age").isin(ages)), originals, "words_sha", "copies", max(1, counted.count()))
        cut = cut.withColumn("__age", age).drop("tag").dropDuplicates(["__age", "doc_id", "words_sha"]).withColumnsRenamed({"doc_id": "__id", "words_sha": "__sha"})
        joined = named.join(cut, (F.col("age") == F.col("__age")) & (F.col("doc_id") == F.col("__id")) & (F.col("words_sha") == F.col("__sha")), "left")
        is_copy = F.coalesce(F.col("doc_id").isNotNull() & (when > F.col("original")) & (F.col("n_words") >= WINDOW), F.lit(False))
        return joined.select(
            "doc_id",
            "n_words",
            F.when(is_copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(is_copy, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("words_sha")))).alias("kept_sha256"),
            *([F.when(is_copy, "").otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
        )


def remove_repeats(docs: DataFrame, batches: int = BATCHES, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with_text adds kept_text where words were removed.

    The documents enter the index in batches of rising doc_id, as they would come in over time.
    """
    whole = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.percentile_approx(F.col("doc_id").cast("long"), [i / batches for i in range(1, batches)], 1000).alias("cuts")).first()
    index = FingerprintIndex(docs.sparkSession, int(max(8, -(-(whole.bytes or 0) // (POSTING_BYTES * BUCKET_ROWS)))))
    cuts = sorted({*(whole.cuts or [])})
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        of_batch = docs.where(F.col("doc_id") > low) if low is not None else docs
        index.add(of_batch.where((F.col("doc_id") <= high) | F.lit(low is None) & F.col("doc_id").isNull()) if high is not None else of_batch)
    try:
        return index.clean(range(len(index.texts)), with_text, last=True)
    finally:
        index.clear()
