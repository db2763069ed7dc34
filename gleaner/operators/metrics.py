"""Metrics of scored, labelled rows, for any grouping, in whole passes over the data.

Rows have label (0 or 1) and score. `keys` are grouping columns; null groups are kept. Ranking metrics need rows in
score order: distinct scores are dealt into ranges, whose totals (RANGES rows a group at most) give each range's
start, and only ranges are sorted - no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 1024
CLIP = 2.220446049250313e-16
BINS = 10
#: Candidate thresholds, as the doubles that equal spacing gives.
GRID = [float(t) for t in np.linspace(0.05, 0.95, 181)]


def edges(bins: int = BINS) -> list[float]:
    return [float(e) for e in np.linspace(0.0, 1.0, bins + 1)]


def _ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def _f1(hit: Column, wrong: Column, missed: Column) -> Column:
    return _ratio(2 * hit, 2 * hit + wrong + missed)


def macro_f1(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Mean F1 of the classes that occur among truths or predictions."""
    one, zero = (tp + fp + fn) > 0, (tn + fp + fn) > 0
    total = F.when(one, _f1(tp, fp, fn)).otherwise(0.0) + F.when(zero, _f1(tn, fn, fp)).otherwise(0.0)
    return total / F.greatest(one.cast("int") + zero.cast("int"), F.lit(1))


def decisions(rows: DataFrame, threshold: Column | float) -> DataFrame:
    """Add predicted: 1 where the score reaches the threshold."""
    return rows.withColumn("predicted", (F.col("score") >= (threshold if isinstance(threshold, Column) else F.lit(threshold))).cast("int"))


def confusion(rows: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp and rows of each group."""
    y, p = F.col("label"), F.col("predicted")
    cells = [F.count_if((y == a) & (p == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))]
    return decisions(rows, threshold).groupBy(*keys).agg(*cells, F.count(F.lit(1)).alias("rows"))


def rates(cells: DataFrame) -> DataFrame:
    """Add accuracy, macro_f1, precision, recall, f1 and false_positive_rate to a confusion table."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cells.withColumns(
        {
            "accuracy": _ratio(tp + tn, F.col("rows")),
            "macro_f1": macro_f1(tp, fp, fn, tn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _f1(tp, fp, fn),
            "false_positive_rate": _ratio(fp, fp + tn),
        }
    )


def ranking(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """roc_auc (ties count half) and pr_auc (average precision) of each group; null with one class only."""
    keys = list(keys)
    distinct = rows.groupBy(*keys, "score").agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    dealt = distinct.withColumn("range", F.floor(-F.col("score") * RANGES).cast("int"))
    totals = dealt.groupBy(*keys, "range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    above = W.partitionBy(*keys).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("range").alias("__range"), F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("n0"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("range") == F.col("__range"))
    inside = W.partitionBy(*keys, "range").orderBy(F.desc("score"))
    placed = dealt.join(starts, same).withColumns({"tp": F.sum("pos").over(inside) + F.col("p0"), "fp": F.sum("neg").over(inside) + F.col("n0")})
    area = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")) / 2.0)
    steps = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    out = placed.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), area.alias("area"), steps.alias("steps"))
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return out.select(*keys, F.when(both, F.col("area") / (F.col("p") * F.col("n"))).alias("roc_auc"), F.when(both, F.col("steps") / F.col("p")).alias("pr_auc"))


def bin_of(score: Column, bins: int = BINS) -> Column:
    """Left-closed bins by the doubles of equal spacing, 0 to bins - 1; the last one holds its right end too."""
    inner = edges(bins)[1:-1]
    return reduce(lambda a, b: a + b, [(score >= F.lit(e)).cast("int") for e in inner])


def reliability(rows: DataFrame, keys: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """For each group and bin, empty ones too: bin (from 1), lower, upper, rows, mean_probability, observed_rate."""
    keys = list(keys)
    clipped = rows.withColumn("score", F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)))
    filled = clipped.groupBy(*keys, (bin_of(F.col("score"), bins) + 1).alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.avg("score").alias("mean_probability"), F.avg(F.col("label").cast("double")).alias("observed_rate"))
    if keys:
        grid = filled.select(*keys).distinct()
    else:
        grid = rows.sparkSession.range(1).select()
    e = edges(bins)
    grid = grid.select("*", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("bin"), F.lit(e[i]).alias("lower"), F.lit(e[i + 1]).alias("upper")) for i in range(bins)])).alias("b")).select(*keys, "b.*")
    on = reduce(lambda a, b: a & b, [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], F.col("g.bin") == F.col("f.bin"))
    joined = grid.alias("g").join(filled.alias("f"), on, "left")
    return joined.select(*[F.col(f"g.{k}").alias(k) for k in keys], "g.bin", "g.lower", "g.upper", F.coalesce("f.rows", F.lit(0)).alias("rows"), "f.mean_probability", "f.observed_rate")


def calibration(rows: DataFrame, keys: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """brier_score, log_loss and expected_calibration_error of each group."""
    keys = list(keys)
    s, y = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)), F.col("label")
    c = F.least(F.greatest(s, F.lit(CLIP)), F.lit(1 - CLIP))
    part = rows.groupBy(*keys, bin_of(s, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(s).alias("s"), F.sum("label").alias("y"), F.sum((s - y) ** 2).alias("brier"), F.sum(F.when(y == 1, -F.ln(c)).otherwise(-F.ln(1 - c))).alias("loss")
    )
    n = F.sum("n")
    return part.groupBy(*keys).agg((F.sum("brier") / n).alias("brier_score"), (F.sum("loss") / n).alias("log_loss"), (F.sum(F.abs(F.col("s") - F.col("y"))) / n).alias("expected_calibration_error"))


def evaluate(rows: DataFrame, threshold: float, keys: Sequence[str] = (), least_rows: int = 0) -> DataFrame:
    """All metrics of each group with at least so many rows."""
    keys = list(keys)
    out = rates(confusion(rows, threshold, keys)).where(F.col("rows") >= least_rows).withColumn("threshold", F.lit(float(threshold)))
    for more in (ranking(rows, keys), calibration(rows, keys)):
        if not keys:
            out = out.crossJoin(more)  # one row each
            continue
        named = more.withColumnsRenamed({k: f"__{k}" for k in keys})
        on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
        out = out.join(named, on, "left").drop(*[f"__{k}" for k in keys])
    return out


def unpivoted(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each slice column: dimension, value (text, True and False for booleans), label, score."""
    kinds = dict(rows.dtypes)
    shown = [F.struct(F.lit(c).alias("dimension"), (F.initcap(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c).cast("string")).alias("value")) for c in columns]
    return rows.select("label", "score", F.explode(F.array(*shown)).alias("s")).select("s.dimension", "s.value", "label", "score")


def slice_report(rows: DataFrame, columns: Sequence[str], threshold: float, least_rows: int = 20) -> DataFrame:
    """All metrics for every value of every slice column."""
    return evaluate(unpivoted(rows, columns), threshold, ["dimension", "value"], least_rows)


def threshold_sweep(rows: DataFrame, grid: Sequence[float] = GRID, keys: Sequence[str] = ()) -> DataFrame:
    """macro_f1 and recall at each threshold, of each group, from one count of rows by the thresholds that their score reaches.

    The grid must be equally spaced.
    """
    grid = list(grid)
    step = (grid[-1] - grid[0]) / (len(grid) - 1)
    table = F.array(*[F.lit(t) for t in grid])
    near = F.least(F.greatest(F.round((F.col("score") - grid[0]) / step), F.lit(0)), F.lit(len(grid) - 1)).cast("int")
    reached = near + (F.col("score") >= F.get(table, near)).cast("int")
    counts = rows.groupBy(*keys, reached.alias("reached")).agg(F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg"))
    points = rows.sparkSession.createDataFrame([(i, t) for i, t in enumerate(grid)], "i int, threshold double")
    joined = F.broadcast(points).join(counts, F.lit(True))  # the grid with its bounded count table
    sums = joined.groupBy(*keys, "i", "threshold").agg(
        F.sum(F.when(F.col("reached") > F.col("i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("reached") > F.col("i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("reached") > F.col("i"), 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(F.col("reached") > F.col("i"), 0).otherwise(F.col("neg"))).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.select(*keys, "threshold", "tp", "fp", "fn", "tn", macro_f1(tp, fp, fn, tn).alias("macro_f1"), _ratio(tp, tp + fn).alias("recall"))


def best_threshold(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row (of each group): the threshold of the best macro F1, then recall, then nearness to 0.5, then the smallest."""
    best = F.struct("macro_f1", "recall", (-F.abs(F.col("threshold") - 0.5)).alias("near"), (-F.col("threshold")).alias("low"), "threshold")
    return sweep.groupBy(*keys).agg(F.max(best).alias("b")).where("b IS NOT NULL").select(*keys, "b.threshold", "b.macro_f1", "b.recall")


def tune_threshold(rows: DataFrame) -> tuple[float, dict[str, float]]:
    labels = sorted(int(r.label) for r in rows.select("label").distinct().limit(3).collect())
    if labels != [0, 1]:
        raise ValueError("a threshold needs both classes")
    best = best_threshold(threshold_sweep(rows)).first()
    return best.threshold, {"macro_f1": best.macro_f1, "recall": best.recall}


def cv_summary(folds: DataFrame, simplicity: dict[str, int]) -> DataFrame:
    """folds: candidate, macro_f1, recall. One row a candidate, the best first."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in simplicity.items() for x in kv])[F.col("candidate")], F.lit(100))
    out = folds.groupBy("candidate").agg(F.avg("macro_f1").alias("mean_macro_f1"), F.min("macro_f1").alias("worst_macro_f1"), F.avg("recall").alias("mean_recall"), F.count(F.lit(1)).alias("folds"))
    return out.withColumn("simplicity", rank).orderBy(F.desc("mean_macro_f1"), F.desc("worst_macro_f1"), F.desc("mean_recall"), "simplicity", "candidate")


def select_with_tolerance(candidates: DataFrame, tolerance: float) -> DataFrame:
    """candidates: candidate, macro_f1, recall, simplicity. One row: within the tolerance of the best F1, the best recall, then the simplest."""
    best = candidates.agg(F.max("macro_f1").alias("best"))
    return candidates.crossJoin(F.broadcast(best)).where(F.col("macro_f1") >= F.col("best") - tolerance).orderBy(F.desc("recall"), F.coalesce("simplicity", F.lit(100)), "candidate").limit(1).drop("best")


def ensemble_grid(rows: DataFrame, weights: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """rows: label, first, second. Threshold and metrics of the weighted means, one row a weight, in one pass."""
    means = [F.struct(F.lit(w).alias("weight"), (F.lit(w) * F.col("first") + F.lit(1 - w) * F.col("second")).alias("score")) for w in weights]
    each = rows.select("label", F.explode(F.array(*means)).alias("e")).select("label", "e.*")
    return best_threshold(threshold_sweep(each, keys=["weight"]), ["weight"])


def ensemble_accepted(grid: DataFrame, single_f1: float, single_recall: float, least_gain: float) -> DataFrame:
    """The best weight, if its F1 gains enough without loss of recall."""
    best = grid.orderBy(F.desc("macro_f1"), F.desc("recall"), "weight").limit(1)
    return best.where((F.col("macro_f1") - single_f1 >= least_gain) & (F.col("recall") >= single_recall))


def perturbation_shift(rows: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """rows: score, baseline. mean_absolute_shift and flip_fraction of each group."""
    flips = (F.col("score") >= threshold) != (F.col("baseline") >= threshold)
    return rows.groupBy(*keys).agg(F.avg(F.abs(F.col("score") - F.col("baseline"))).alias("mean_absolute_shift"), F.avg(flips.cast("double")).alias("flip_fraction"))
