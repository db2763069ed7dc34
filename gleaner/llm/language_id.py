"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: character 1- to 3-grams of the lower-cased letters of a whole text (every other run of characters is one
blank), hashed into FEATURES cells; weight (1 + ln tf) * idf, scaled to length 1. Document frequencies are counted
over all training documents by partial aggregation (FEATURES rows at most from each task). The weights are fitted
by follow-the-regularised-leader with an elastic-net penalty on a bounded sample: the first documents in order of a
hash of doc_id, at most SAMPLE_PER_LABEL of each label and SAMPLE_ROWS of all, until they have SAMPLE_CELLS features.
One executor task fits them; the driver sees the fitted weights alone. One part of the sample is left out of the fit
and serves to choose the temperature by which scores are divided. The model has FEATURES x labels numbers at most,
whatever the input, and is broadcast; prediction is one narrow stage.

Only text and non-null lang of the rows outside the held-out fold (crc32 of doc_id as text, modulo 5, is 0) are
learned from. Defined cases: `und` with score 0 for a null text, a text without letters, or when nothing was
learned; one learned label is predicted with score 1. Repeated rows count repeatedly. A null doc_id is in no fold:
its row isn't learned from and held_out is null. A very long text has FEATURES cells at most, and batches are bounded
by bytes. Of more than MAX_LABELS languages the most frequent ones are learned (ties in order of name). Where too few
documents were learned from to calibrate scores, `keep_identified` rejects texts without letters alone. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm._common import use_small_arrow_batches

FEATURES = 1 << 15
#: The bounds of the sample that the weights are fitted on: documents of a label, documents, and their cells.
SAMPLE_PER_LABEL = 2_000
SAMPLE_ROWS = 20_000
SAMPLE_CELLS = 16_000_000
MAX_LABELS = 200
#: Left-out documents that a temperature needs.
CALIBRATION_ROWS = 4
FOLDS = 5
UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells in rising order, and how often each occurs; none for a text without letters."""
    letters = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not letters:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), dtype=np.uint32)
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ np.uint32(0x7F4A7C15)) * np.uint32(0x85EBCA6B) + codes[1:]
    three = (two[:-1] ^ np.uint32(0x165667B1)) * np.uint32(0xC2B2AE35) + codes[2:]
    cells = []
    for h, seed in ((one, 0x2545F491), (two, 0x27D4EB2F), (three, 0x9E3779F9)):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(seed)
        cells.append((h ^ (h >> np.uint32(13))) % np.uint32(FEATURES))
    counts = np.bincount(np.concatenate(cells), minlength=FEATURES)
    found = np.flatnonzero(counts)
    return found, counts[found]


@dataclass(frozen=True)
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES x labels
    bias: np.ndarray
    temperature: float
    calibrated: bool = False

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return weighted(*features(text), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        cells, values = self.vector(text)
        if not len(cells):
            return UNDETERMINED, 0.0
        p = softmax((values @ self.weights[cells] + self.bias)[None, :] / self.temperature)[0]
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def weighted(cells: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = (1 + np.log(counts)) * idf[cells] if len(cells) else np.zeros(0)
    norm = np.sqrt((values**2).sum())
    return cells, values / norm if norm > 0 else values


def _compact(cells: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cells.astype(np.int32), values.astype(np.float32)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, labels: int, *, epochs: int = 3, batch: int = 32, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal over small batches; l1 and l2 make the elastic net, the bias is free of it."""
    z, n = np.zeros((FEATURES, labels)), np.zeros((FEATURES, labels))
    zb, nb, bias = np.zeros(labels), np.zeros(labels), np.zeros(labels)

    def proximal(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        turn = order.permutation(len(rows))
        for at in range(0, len(turn), batch):
            some = turn[at : at + batch]
            cells = np.concatenate([rows[i][0] for i in some])
            values = np.concatenate([rows[i][1] for i in some])
            doc = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            touched, local = np.unique(cells, return_inverse=True)
            w = proximal(z[touched], n[touched])
            x = np.zeros((len(some), len(touched)))
            x[doc, local] = values
            error = softmax(x @ w + bias)
            error[np.arange(len(some)), label[some]] -= 1
            g = x.T @ error / len(some)
            sigma = (np.sqrt(n[touched] + g * g) - np.sqrt(n[touched])) / alpha
            z[touched] += g - sigma * w
            n[touched] += g * g
            gb = error.mean(axis=0)
            zb += gb - (np.sqrt(nb + gb * gb) - np.sqrt(nb)) / alpha * bias
            nb += gb * gb
            bias = -zb / ((beta + np.sqrt(nb)) / alpha)
    return proximal(z, n), bias


def choose_temperature(scores: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the scores with the least log loss on documents that the fit hasn't seen."""
    if not len(scores):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(5), 80))
    loss = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(label)), label], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            cells, _ = features(text)
            df[cells] += 1
            rows += 1
    found = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"cell": pa.array([*found, -1], pa.int32()), "n": pa.array([*df[found], rows], pa.int64())})


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {"draw": batch.column("draw"), "tie": batch.column("tie"), "lang": batch.column("lang"), "cells": pa.array([c for c, _ in found], pa.list_(pa.int32())), "counts": pa.array([c for _, c in found], pa.list_(pa.int32()))}
        )


def _fitter(labels: list[str], idf: np.ndarray):
    """Fit the bounded sample in the one task that it comes to: rows (cell, weights); cell -1 is the bias, -2 the temperature, if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(labels)}
        vectors, label, held = [], [], 0
        for batch in batches:
            for lang, cells, counts in zip(batch.column("lang").to_pylist(), batch.column("cells"), batch.column("counts"), strict=True):
                found = cells.values.to_numpy(zero_copy_only=False)
                if len(found) and held < SAMPLE_CELLS:
                    vectors.append(_compact(*weighted(found, counts.values.to_numpy(zero_copy_only=False), idf)))
                    label.append(place[lang])
                    held += len(found)
        y, at = np.array(label, dtype=np.int64), np.arange(len(label))
        left_out = (at % 5 == 0) & (len(label) >= 5 * CALIBRATION_ROWS)
        fitted = np.flatnonzero(~left_out)
        weights, bias = fit_ftrl([vectors[i] for i in fitted], y[fitted], len(labels)) if len(fitted) else (np.zeros((FEATURES, len(labels))), np.zeros(len(labels)))
        used = np.flatnonzero(weights.any(axis=1))
        cell, out = [*used.tolist(), -1], [*weights[used].tolist(), bias.tolist()]
        if left_out.any():
            scores = np.array([vectors[i][1] @ weights[vectors[i][0]] + bias for i in np.flatnonzero(left_out)]).reshape(-1, len(labels))
            cell.append(-2), out.append([choose_temperature(scores, y[left_out])])
        yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int32()), "weights": pa.array(out, pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> Model:
    """A model of text -> lang, learned from the rows outside the held-out fold."""
    use_small_arrow_batches(docs.sparkSession)
    learned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 0))
    per_label = {r.lang: r.n for r in learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LABELS).collect()}
    labels = sorted(per_label)
    if not labels:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    learned = learned.where(F.col("lang").isin(labels))
    df = np.zeros(FEATURES, np.int64)
    rows = 0
    for r in learned.select("text").mapInArrow(_document_frequencies, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # FEATURES + 1 rows at most
        if r.cell < 0:
            rows = r.n
        else:
            df[r.cell] = r.n
    idf = np.log((1 + rows) / (1 + df)) + 1
    wanted = min(sample_per_label, SAMPLE_ROWS // len(labels))
    # every cell of a document counts once in df, so their sum tells how many cells so many documents have
    thin = min(1.0, SAMPLE_CELLS / max(1.0, df.sum() / max(1, rows) * sum(min(wanted, n) for n in per_label.values())))
    share = F.create_map(*[F.lit(x) for k, n in per_label.items() for x in (k, min(1.0, wanted / n) * thin)])[F.col("lang")]
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col("doc_id")), 33)
    drawn = learned.withColumn("draw", draw).where(F.col("draw") < share * float(1 << 31))
    # rows of one doc_id draw alike; the digest of their text settles their order
    featurised = drawn.select("draw", F.xxhash64("text").alias("tie"), "lang", "text").mapInArrow(_featurised, "draw long, tie long, lang string, cells array<int>, counts array<int>")
    sample = featurised.orderBy("draw", "tie", "lang").limit(SAMPLE_ROWS + SAMPLE_ROWS // 10).select("lang", "cells", "counts")
    fitted = sample.mapInArrow(_fitter(labels, idf), "cell int, weights array<double>").toArrow()
    weights, bias, temperature = np.zeros((FEATURES, len(labels))), np.zeros(len(labels)), None
    flat = fitted["weights"].combine_chunks().flatten().to_numpy()
    lengths = fitted["weights"].combine_chunks().value_lengths().to_numpy()
    edges = np.concatenate([[0], np.cumsum(lengths)])
    for cell, a, b in zip(fitted["cell"].to_pylist(), edges, edges[1:], strict=False):
        if cell >= 0:
            weights[cell] = flat[a:b]
        elif cell == -1:
            bias = flat[a:b].copy()
        else:
            temperature = float(flat[a])
    return Model(labels, idf, weights, bias, temperature or 1.0, temperature is not None)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    use_small_arrow_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [held.value.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array([a for a, _ in found], pa.string()), "score": pa.array([b for _, b in found], pa.float64())})

    said = docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return said.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def identify_languages(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))


def keep_identified(docs: DataFrame, least_score: float = 0.5) -> DataFrame:
    """The documents whose language the model tells with at least this score, with all their columns.

    Texts without letters always go; if scores couldn't be calibrated, nothing else does.
    """
    model = fit(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def told(text):
        import pandas as pd

        if held.value.calibrated:
            found = [held.value.predict(t) for t in text]
            return pd.Series([label != UNDETERMINED and score >= least_score for label, score in found], dtype=bool)
        return pd.Series([t is not None and any(map(str.isalpha, t)) for t in text], dtype=bool)

    return docs.where(told(F.col("text")))
