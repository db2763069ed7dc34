"""Approximate nearest neighbours: inverted file of coarse centroids, product-quantised residuals, exact reranking.

Coarse centroids and the codebooks of the residuals are fitted on a sample drawn by a hash of vec_id: SAMPLE rows, or
ROWS_PER_CENTROID for each list where that is more, up to MAX_LISTS lists. Every row is indexed: it gets the list of its
nearest centroid and a code of SUBSPACES bytes for its residual. A query visits the lists of its `probes` nearest
centroids; by default as many as hold RECALL of the k nearest sampled rows, for sampled queries the fit hasn't seen. Lists are dealt into chunks of about CHUNK rows, so a list
that holds a third of all rows is many chunks, and a query's copies meet each chunk of a list. Within a chunk the
query's asymmetric distance tables rank the codes, and the best RERANK rows are measured exactly on the original vectors.
The k-th of these is a limit; every other row whose rough distance, less the error of its own code, is within the limit
is measured too. So a chunk gives its true nearest rows, however many rows share a code; these are merged by query.

Short lists that follow each other share a bin of about CHUNK rows, so a query's vector is copied for each bin that
holds some of its lists, and not for each list.

Bounds: the sample has at most MAX_LISTS * ROWS_PER_CENTROID rows, a tenth more included; centroids and codebooks are
broadcast. Beyond MAX_LISTS lists, these get longer. Queries are shuffled, not broadcast. A task holds a bin's or a
chunk's rows and goes through its queries in blocks. The cost of the search is queries x probes x list length, the
usual one for inverted files.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take
no part, neither as queries nor as candidates; rows with the query's own vec_id are the query's own and are no
candidates; other repeated rows are candidates each; fewer candidates than k give fewer rows; ties go to the smaller
vec_id; rows without a vec_id take no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm._common import stored, use_small_arrow_batches

SAMPLE = 20_000
MAX_LISTS = 4096
ROWS_PER_CENTROID = 16
#: This share of the nearest sampled rows of held-out queries lies in the lists that are visited.
RECALL = 0.975
HELD_OUT = 8
MEASURED = 256
ROWS_PER_LIST = 256
SUBSPACES = 16
CODES = 256
CHUNK = 4096
RERANK = 128
QUERY_BLOCK = 64
LEAST_PROBES = 8
#: So many queries at most, about, meet one copy of a chunk.
QUERIES_PER_CHUNK = 8192


def usable(vector: Column, length: int) -> Column:
    """A vector of this length, all components finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == length) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """At most k centres; empty ones are set on the rows farthest from theirs."""
    distinct = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    if len(distinct) <= k:
        return distinct
    centres = distinct[rng.choice(len(distinct), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        to, far = nearest(x, centres, 1)
        to = to[:, 0]
        n = np.bincount(to, minlength=k)
        total = np.zeros((k, x.shape[1]), np.float64)
        np.add.at(total, to, x)
        full = n > 0
        centres[full] = (total[full] / n[full, None]).astype(np.float32)
        if (~full).any():
            centres[~full] = x[np.argsort(-far[:, 0], kind="stable")[: int((~full).sum())]]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and squared distances of the k nearest centres of each row, in blocks."""
    k = min(k, len(centres))
    norm = (centres.astype(np.float32) ** 2).sum(axis=1)
    found, squared = [], []
    for a in range(0, len(x), 2048):
        part = x[a : a + 2048].astype(np.float32)
        d = norm[None, :] - 2 * part @ centres.T
        if k == 1:
            best = d.argmin(axis=1)[:, None]
        elif k < len(centres):
            best = np.argpartition(d, k - 1, axis=1)[:, :k]
        else:
            best = np.tile(np.arange(k), (len(part), 1))
        of = np.take_along_axis(d, best, axis=1)
        order = np.argsort(of, axis=1, kind="stable")
        found.append(np.take_along_axis(best, order, axis=1))
        squared.append(np.take_along_axis(of, order, axis=1) + (part**2).sum(axis=1)[:, None])
    return (np.concatenate(found), np.concatenate(squared)) if found else (np.zeros((0, k), np.int64), np.zeros((0, k), np.float32))


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x length
    codebooks: list[np.ndarray]  # of each subspace: codes x its length
    cuts: np.ndarray  # the subspaces' edges

    def encode(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([nearest(residuals[:, a:b], book, 1)[0][:, 0] for book, a, b in zip(self.codebooks, self.cuts, self.cuts[1:], strict=False)], axis=1).astype(np.uint8)

    def tables(self, residuals: np.ndarray) -> list[np.ndarray]:
        """For each subspace: squared distance of every query's part to every code."""
        out = []
        for book, a, b in zip(self.codebooks, self.cuts, self.cuts[1:], strict=False):
            part = residuals[:, a:b]
            out.append((part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)[None, :])
        return out


def fit_index(sample: np.ndarray, lists: int, subspaces: int = SUBSPACES) -> Index:
    centroids = kmeans(sample, lists, 12, 1)
    residuals = sample - centroids[nearest(sample, centroids, 1)[0][:, 0]]
    cuts = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
    return Index(centroids, [kmeans(np.ascontiguousarray(residuals[:, a:b]), CODES, 8, 2) for a, b in zip(cuts, cuts[1:], strict=False)], cuts)


def measured_probes(index: Index, sample: np.ndarray, unseen: np.ndarray, k: int, recall: float = RECALL) -> int:
    """How many lists to visit for this share of the k nearest rows of the sample, for queries the fit hasn't seen.

    The sample's rows lie thinner than the table's, so their neighbours are farther and the number errs upwards.
    """
    lists = len(index.centroids)
    rows, asked = np.unique(sample, axis=0), np.unique(unseen, axis=0)
    if lists <= LEAST_PROBES or len(rows) < 2 or not len(asked):
        return lists
    asked = asked[np.random.default_rng(5).permutation(len(asked))[:MEASURED]]
    to = nearest(rows, index.centroids, 1)[0][:, 0]
    near = nearest(asked, rows, k + 1)[0][:, 1:]  # the first is the row itself
    place = np.argsort(nearest(asked, index.centroids, lists)[0], axis=1)  # a list's place in the query's order
    places = np.sort(np.take_along_axis(place, to[near], axis=1), axis=None)
    return int(min(lists, max(LEAST_PROBES, 1 + places[int(np.ceil(recall * len(places))) - 1])))


def _matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _assign(held, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        for batch in batches:
            x = _matrix(batch.column("vector"), length).astype(np.float32)
            to = nearest(x, index.centroids, 1)[0][:, 0] if len(x) else np.zeros(0, np.int64)
            codes = index.encode(x - index.centroids[to]) if len(x) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(to, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "vector", "list", "code"])

    return run


def _probe(held, places: dict[int, tuple[int, int]], length: int, probes: int):
    """A row for each query and bin that holds some of its lists; places: list -> (bin, chunks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = len(held.value.centroids)
        bins, chunks = np.full(lists, -1, np.int32), np.zeros(lists, np.int32)
        for n, (where, parts) in places.items():
            bins[n], chunks[n] = where, parts
        for batch in batches:
            to = nearest(_matrix(batch.column("vector"), length).astype(np.float32), held.value.centroids, probes)[0]
            row, found = np.repeat(np.arange(len(to)), to.shape[1]), to.reshape(-1)
            row, found = row[bins[found] >= 0], found[bins[found] >= 0]
            order = np.lexsort((found, bins[found], row))
            row, found = row[order], found[order]
            first = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(bins[found], prepend=-1))
            visited = pa.ListArray.from_arrays(pa.array(np.append(first, len(found)), pa.int32()), pa.array(found, pa.int32()))
            asked = batch.select(["vec_id", "vector"]).take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([*asked.columns, pa.array(bins[found[first]]), pa.array(chunks[found[first]]), visited], names=["vec_id", "vector", "bin", "chunks", "lists"])

    return run


def _nearest_in_list(index: Index, number: int, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, asked: np.ndarray, wanted: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query: its number, and ids and distances of its k nearest rows in this list's part."""
    centroid = index.centroids[number]
    decoded = centroid.astype(np.float64) + np.concatenate([book[codes[:, s]] for s, book in enumerate(index.codebooks)], axis=1)
    extent = max(1e-30, float((decoded**2).sum(axis=1).max()), float((vectors**2).sum(axis=1).max()), float((centroid.astype(np.float64) ** 2).sum()))
    error = np.sqrt(((vectors - decoded) ** 2).sum(axis=1)) + 1e-5 * np.sqrt(extent)
    for a in range(0, len(asked), QUERY_BLOCK):
        q = wanted[a : a + QUERY_BLOCK]
        tables = index.tables(q.astype(np.float32) - centroid)
        rough = sum(t[:, codes[:, s]] for s, t in enumerate(tables))
        # no row is nearer than this: its code's distance, less the code's error and what single precision loses
        lost = 1e-5 * ((q**2).sum(axis=1) + extent)
        least = np.sqrt(np.maximum(rough - lost[:, None], 0)) - error[None, :]
        own = asked[a : a + QUERY_BLOCK, None] == ids[None, :]
        rough[own] = least[own] = np.inf
        for i in range(len(q)):
            best = np.argpartition(rough[i], rerank - 1)[:rerank] if rerank < len(ids) else np.arange(len(ids))
            best = best[np.isfinite(rough[i][best])]
            exact = np.sqrt(((vectors[best] - q[i]) ** 2).sum(axis=1))
            limit = np.partition(exact, k - 1)[k - 1] if len(exact) >= k else np.finfo(np.float64).max
            more = least[i] <= limit
            more[best] = False
            more = np.flatnonzero(more)
            best = np.concatenate([best, more])
            exact = np.concatenate([exact, np.sqrt(((vectors[more] - q[i]) ** 2).sum(axis=1))])
            first = np.lexsort((ids[best], exact))[:k]
            yield np.full(len(first), asked[a + i]), ids[best][first], exact[first]


def _search(held, length: int, k: int, rerank: int):
    """Each query's k nearest rows of a bin, among the lists that it visits."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if queries.num_rows and rows.num_rows:
            order = np.lexsort((rows["vec_id"].to_numpy(), rows["list"].to_numpy()))
            ids, numbers = rows["vec_id"].to_numpy()[order], rows["list"].to_numpy()[order]
            vectors = _matrix(rows["vector"], length).astype(np.float64)[order]
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            asked, wanted = queries["vec_id"].to_numpy(), _matrix(queries["vector"], length).astype(np.float64)
            visited = queries["lists"].combine_chunks()
            asks, lists = np.repeat(np.arange(len(asked)), visited.value_lengths().to_numpy()), visited.flatten().to_numpy()
            edges = np.append(np.flatnonzero(np.diff(numbers, prepend=-1)), len(ids))
            for a, b in zip(edges, edges[1:], strict=False):
                by = asks[lists == numbers[a]]
                found += _nearest_in_list(held.value, numbers[a], ids[a:b], vectors[a:b], codes[a:b], asked[by], wanted[by], k, rerank)
        query, near, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((near, score, query))
        query, near, score = query[order], near[order], score[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < k
        return pa.table({"query_id": pa.array(query[kept], pa.int64()), "vec_id": pa.array(near[kept], pa.int64()), "score": pa.array(score[kept], pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
    """The k nearest rows of vectors for each row of queries, both with vec_id and vector: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    use_small_arrow_batches(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = vectors.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).where("n > 0").orderBy(F.desc("rows"), "n").limit(1).collect()
    if not lengths:
        return empty
    length = lengths[0].n
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), length))
    total = rows.count()
    if not total:
        return empty
    lists = min(MAX_LISTS, max(1, total // ROWS_PER_LIST))
    size = max(SAMPLE, lists * ROWS_PER_CENTROID)
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit(9), "vec_id"), 33) < F.lit(min(1.0, size / total) * float(1 << 31)))
    sample = _matrix(drawn.select("vec_id", "vector").orderBy("vec_id").limit(size + size // 10).toArrow()["vector"], length).astype(np.float32)
    unseen = np.arange(len(sample)) % HELD_OUT == 0 if lists > LEAST_PROBES else np.zeros(len(sample), bool)
    index = fit_index(sample[~unseen], int(min(lists, max(1, len(sample) // ROWS_PER_CENTROID))))
    probes = probes or measured_probes(index, sample, sample[unseen], k)
    del sample
    held = spark.sparkContext.broadcast(index)
    vector = f"vector {rows.schema['vector'].dataType.simpleString()}"
    indexed = stored(rows.select("vec_id", "vector").mapInArrow(_assign(held, length), f"vec_id long, {vector}, list int, code binary"), "index")
    sizes = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).orderBy("list").collect()  # MAX_LISTS rows at most
    places, before = {}, 0
    for r in sizes:  # short lists share bins, a long one has chunks of its own
        chunks = -(-r.n // CHUNK)
        places[r.list] = (lists + r.list, chunks) if chunks > 1 else (before // CHUNK, 1)
        before += r.n if chunks == 1 else 0
    table = F.broadcast(spark.createDataFrame([(n, *p) for n, p in places.items()], "list int, bin int, chunks int"))
    dealt = indexed.join(table, "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")).drop("chunks")
    asked = queries.where(F.col("vec_id").isNotNull() & usable(F.col("vector"), length)).select("vec_id", "vector")
    visits = asked.mapInArrow(_probe(held, places, length, probes), f"vec_id long, {vector}, bin int, chunks int, lists array<int>")
    # a bin that very many queries visit is held in several copies, each for a part of them
    parts = visits.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERIES_PER_CHUNK).cast("int").alias("parts"))  # 2 x MAX_LISTS rows at most
    visits = visits.join(F.broadcast(parts), "bin").select("vec_id", "vector", "lists", "bin", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    dealt = dealt.join(F.broadcast(parts), "bin").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ["bin", "chunk", "part"]
    near = visits.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(_search(held, length, k, rerank), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(embeddings: DataFrame, step: int = 100, k: int = 10) -> DataFrame:
    """Queries: the rows of embeddings whose vec_id is divisible by step; candidates: all rows but the query's own."""
    kind = embeddings.schema["embedding"].dataType.simpleString()
    exact = kind if kind == "array<float>" else "array<double>"  # scores are measured on the vectors as they are
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(exact).alias("vector"))
    return search(rows, rows.where(F.col("vec_id") % step == 0), k)
