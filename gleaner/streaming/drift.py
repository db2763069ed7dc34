"""Drift as a stream: windows of scored records, compared with a baseline as each window closes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import metrics as M
from gleaner.operators import monitoring as MON


def windowed_counts(records: DataFrame, *, window: str = "1 day", late: str = "1 hour", bins: int = M.BINS) -> DataFrame:
    """records: timestamp, probability, predicted_label. For each window and score bin: rows and positives.

    Works on streams and on tables. In a stream, records later than the watermark are left out of closed windows;
    the state has a row for each open window and bin, whatever the traffic.
    """
    marked = records.withWatermark("timestamp", late) if records.isStreaming else records
    grouped = marked.groupBy(F.window("timestamp", window).alias("w"), M.bin_of(F.col("probability"), bins).alias("bin"))
    counts = grouped.agg(F.count(F.lit(1)).alias("rows"), F.sum("predicted_label").cast("long").alias("positives"))
    return counts.select(F.col("w.start").alias("window_start"), "bin", "rows", "positives")


def window_report(counts: DataFrame, baseline: MON.Baseline) -> DataFrame:
    """counts of closed windows: window_start, rows, score_psi, prevalence_change, status."""
    spark = counts.sparkSession
    expected = F.broadcast(spark.createDataFrame(list(enumerate(baseline.score_bin_fractions)), "bin int, expected double"))
    totals = counts.groupBy("window_start").agg(F.sum("rows").alias("n"), F.sum("positives").alias("p"))
    grid = totals.crossJoin(expected)  # the baseline's few bins for each window
    filled = grid.join(counts.select("window_start", "bin", "rows"), ["window_start", "bin"], "left").withColumn("observed", F.coalesce("rows", F.lit(0)) / F.col("n"))
    out = filled.groupBy("window_start", "n", "p").agg(F.sum(MON.psi(F.col("observed"), F.col("expected"))).alias("score_psi"))
    change = F.abs(F.col("p") / F.col("n") - F.lit(baseline.predicted_fraction))
    alert = (F.col("score_psi") >= baseline.score_psi_alert) | (change >= baseline.prevalence_alert)
    return out.select("window_start", F.col("n").alias("rows"), "score_psi", change.alias("prevalence_change"), F.when(alert, "alert").otherwise("ok").alias("status"))


def start_monitor(lines: DataFrame, baseline: MON.Baseline, sink: Callable[[DataFrame, int], None], checkpoint: str, **windows: str):
    """Check streamed JSON lines, count them by window, and hand each batch of closed windows' reports to sink.

    A bad line is left out here; a batch run over the same files (`monitoring.validated`) names it.
    """
    good = MON.parsed(lines).where("error IS NULL").select("timestamp", "probability", "predicted_label")
    counts = windowed_counts(good, **windows)
    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(window_report(df, baseline), n)).start()
