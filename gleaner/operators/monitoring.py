"""Drift of scored batches against a stored baseline, without any message content.

A record has timestamp, probability, predicted_label, optionally true_label and slices (a map of texts). Batches come
as JSON lines; every line is checked, and one bad line fails the batch (`validated`), or is counted (`errors`).
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import private_dimension
from gleaner.operators import metrics as M

# What records may not and must hold.
FORBIDDEN = ("text", "body", "subject", "message", "email", "raw", "content")
REQUIRED = ("timestamp", "probability", "predicted_label")
FLOOR = 1e-6
ISO = r"^\d{4}-?\d{2}-?\d{2}([ T]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?([+-]\d{2}(:?\d{2}(:?\d{2})?)?|Z)?)?$"


@dataclass
class Baseline:
    score_bin_edges: list[float]
    score_bin_fractions: list[float]
    predicted_fraction: float
    slice_fractions: dict[str, dict[str, float]] = field(default_factory=dict)
    threshold: float = 0.5
    macro_f1: float | None = None
    score_psi_alert: float = 0.2
    prevalence_alert: float = 0.1
    slice_alert: float = 0.15
    macro_f1_alert: float = 0.05

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def parsed(lines: DataFrame) -> DataFrame:
    """lines: value, line. Each line that isn't blank with its fields, and error: the first rule that it breaks, or null."""
    raw = lines.where(F.trim(F.regexp_replace("value", r"(?U)\s", " ")) != "")
    v = F.try_parse_json("value")
    kept = raw.select("line", v.alias("v")).withColumn("m", F.try_variant_get("v", "$", "map<string,variant>"))
    keys = F.transform(F.map_keys("m"), lambda k: F.lower(k))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    label = text("predicted_label")
    predicted = F.when(label.isin("safe", "0", "false", "0.0"), 0).when(label.isin("phishing", "1", "true", "1.0"), 1)
    slices = F.try_variant_get("v", "$.slices", "map<string,variant>")
    has_slices = F.map_contains_key("m", "slices")
    probability = F.expr("try_cast(try_variant_get(v, '$.probability', 'string') AS double)")
    forbidden = F.arrays_overlap(keys, F.array(*[F.lit(k) for k in FORBIDDEN]))
    missing = reduce(lambda a, b: a | b, [~F.map_contains_key("m", k) for k in REQUIRED])
    stamp = text("timestamp")
    error = (
        F.when(F.col("m").isNull(), "not_an_object")
        .when(forbidden, "forbidden_fields")
        .when(missing, "missing_fields")
        .when(stamp.isNull() | ~stamp.rlike(ISO) | F.try_to_timestamp(stamp).isNull(), "bad_timestamp")
        .when(probability.isNull() | F.isnan(probability) | ~probability.between(0, 1), "bad_probability")
        .when(predicted.isNull(), "bad_predicted_label")
        .when(has_slices & slices.isNull(), "bad_slices")
    )
    shown = F.transform_values(slices, lambda k, x: private_dimension(k, F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("None"))))
    return kept.select(
        "line",
        error.alias("error"),
        F.try_to_timestamp(stamp).alias("timestamp"),
        probability.alias("probability"),
        predicted.alias("predicted_label"),
        F.expr("try_cast(try_variant_get(v, '$.true_label', 'string') AS int)").alias("true_label"),
        F.coalesce(shown, F.create_map().cast("map<string,string>")).alias("slices"),
    )


def validated(lines: DataFrame) -> DataFrame:
    """The records of a batch; fails if it has none, or a line breaks a rule."""
    rows = parsed(lines)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("error").isNotNull(), F.struct("line", "error"))).alias("bad")).first()
    if not seen.n:
        raise ValueError("the batch has no records")
    if seen.bad:
        raise ValueError(f"line {seen.bad.line}: {seen.bad.error}")
    return rows.drop("error")


def histogram(rows: DataFrame, edges: list[float]) -> DataFrame:
    """bin (from 0) and fraction of rows, empty bins too; bins are closed on the left, the last one on both sides."""
    s, last = F.col("probability"), len(edges) - 2
    inner = reduce(lambda a, b: a + b, [(s >= F.lit(e)).cast("int") for e in edges[1:-1]], F.lit(0))
    counts = rows.where(s.between(edges[0], edges[-1])).groupBy(inner.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    grid = rows.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").crossJoin(F.broadcast(total)).select("bin", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("fraction"))


def psi(observed: Column, expected: Column) -> Column:
    """A bin's part of the population stability index; both fractions are raised to a floor."""
    o, e = F.greatest(observed, F.lit(FLOOR)), F.greatest(expected, F.lit(FLOOR))
    return (o - e) * F.ln(o / e)


def slice_fractions(rows: DataFrame) -> DataFrame:
    """dimension, value, fraction of all rows; rows without a dimension that others have count as <missing>."""
    total = F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))
    each = rows.select(F.explode("slices").alias("dimension", "value")).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    missing = each.groupBy("dimension").agg(F.sum("n").alias("n")).crossJoin(total).where("n < total").select("dimension", F.lit("<missing>").alias("value"), (F.col("total") - F.col("n")).alias("n"))
    both = each.unionByName(missing).groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    return both.crossJoin(total).select("dimension", "value", (F.col("n") / F.col("total")).alias("fraction"))


def slice_drift(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """dimension, maximum_absolute_change, for the dimensions that are observed; a value that one side lacks has 0 there."""
    seen = observed.select("dimension").distinct()
    e = expected.join(seen, "dimension", "left_semi").withColumnRenamed("fraction", "expected")
    both = observed.join(e, ["dimension", "value"], "full_outer")
    change = F.abs(F.coalesce("fraction", F.lit(0.0)) - F.coalesce("expected", F.lit(0.0)))
    return both.groupBy("dimension").agg(F.max(change).alias("maximum_absolute_change"))


def baseline_of(rows: DataFrame, threshold: float, slices: list[str], bins: int = M.BINS, macro_f1: float | None = None) -> Baseline:
    """rows: score, and the slice columns. What later batches are held against."""
    edges = M.edges(bins)
    scored = rows.select(F.col("score").alias("probability"), *slices)
    bars = [r.fraction for r in histogram(scored, edges).orderBy("bin").collect()]
    share = rows.agg(F.avg((F.col("score") >= threshold).cast("double")).alias("p")).first().p
    each = M.unpivoted(rows.withColumn("label", F.lit(0)), slices).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    n = rows.count()
    fractions: dict[str, dict[str, float]] = {}
    for r in each.collect():
        fractions.setdefault(r.dimension, {})[str(r.value)] = r.n / n
    return Baseline(edges, bars, share, fractions, threshold, macro_f1)


def monitor(rows: DataFrame, baseline: Baseline) -> dict:
    """The drift report of a batch of validated records: aggregates only, nothing of the records themselves."""
    spark = rows.sparkSession
    expected = spark.createDataFrame(list(enumerate(baseline.score_bin_fractions)), "bin int, expected double")
    score_psi = histogram(rows, baseline.score_bin_edges).join(F.broadcast(expected), "bin").agg(F.sum(psi(F.col("fraction"), F.col("expected"))).alias("psi")).first().psi
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("predicted_label").cast("double")).alias("p"), F.count("true_label").alias("labelled")).first()
    change = abs(whole.p - baseline.predicted_fraction)
    fractions = slice_fractions(rows)
    told = spark.createDataFrame([(d, v, float(f)) for d, m in baseline.slice_fractions.items() for v, f in m.items()], "dimension string, value string, fraction double")
    drift = {r.dimension: r.maximum_absolute_change for r in slice_drift(fractions, told).collect()}
    values: dict[str, dict[str, float]] = {}
    for r in fractions.orderBy("dimension", "value").collect():
        values.setdefault(r.dimension, {})[r.value] = r.fraction
    alerts = ["score_distribution_drift"] * (score_psi >= baseline.score_psi_alert) + ["predicted_prevalence_drift"] * (change >= baseline.prevalence_alert)
    alerts += [f"slice_drift:{d}" for d, c in drift.items() if c >= baseline.slice_alert]
    performance = None
    if whole.labelled:
        labelled = rows.where(F.col("true_label").isNotNull()).select(F.col("true_label").alias("label"), F.col("probability").alias("score"))
        performance = M.evaluate(labelled, baseline.threshold).first().asDict()
        if baseline.macro_f1 is not None and baseline.macro_f1 - performance["macro_f1"] >= baseline.macro_f1_alert:
            alerts.append("performance_degradation")
    return {
        "schema_version": 1,
        "rows": whole.n,
        "content_retained": False,
        "score_population_stability_index": score_psi,
        "predicted_fraction": whole.p,
        "predicted_prevalence_absolute_change": change,
        "slice_drift": {d: {"fractions": values[d], "maximum_absolute_change": c} for d, c in sorted(drift.items())},
        "performance": performance,
        "alerts": sorted({*alerts}),
        "status": "alert" if alerts else "ok",
    }
