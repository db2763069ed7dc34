"""Runs: from a clean corpus to a published artifact, its reports, predictions with it, and a check of what it says.

An artifact is a folder <artifacts>/<run> with manifest.json and model.zip; its reports are in <reports>/<run>. What the
driver holds here are small results: metrics, thresholds, manifests. Rows stay in DataFrames.
"""

from __future__ import annotations

import io
import json
import platform
import shutil
import sys
import time
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from importlib import metadata
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.config import Config
from gleaner.operators import folds as D
from gleaner.operators import metrics as M
from gleaner.operators import models as L
from gleaner.operators import monitoring as MON
from gleaner.plans import charts, files
from gleaner.plans import training as R
from gleaner.plans.privacy import scan_bytes
from gleaner.plans.reports import load_csv, load_json, save_csv, save_json, save_whole, shown_name, shown_time
from gleaner.plans.scratch import materialised
from gleaner.sources.mail import message_text

MODEL_FILE = "model.zip"
SLICES = ("length_slice", "has_html", "has_url", "has_obfuscation", "attachment_slice", "language_slice", "source", "domain_group", "campaign_group")
#: What a recovered run's metrics may differ by.
TOLERANCE = 1e-12
GATED = ("accuracy", "macro_f1", "precision", "recall", "f1", "false_positive_rate", "roc_auc", "pr_auc")
PERIODS = ((2014, 2023), (2024, 2024), (2025, 2025))
PACKAGES = ("pyspark", "pyarrow", "pandas", "numpy")


def _now() -> str:
    return datetime.now(UTC).isoformat()


def pack_model(spark: SparkSession, model: L.Fitted, to: Path) -> dict:
    """Save a model as one file, after a scan of its parts, their names and the file itself for personal data; the scan's result.

    Members have fixed names and times, so equal models give equal files. A file that a later scan would refuse is never written.
    """
    files_of = L.to_files(model)
    scanned = scan_bytes(spark, files_of)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files_of):
            z.writestr(zipfile.ZipInfo(name), files_of[name], zipfile.ZIP_DEFLATED)
    scan_bytes(spark, {to.name: out.getvalue()})
    save_whole(to, out.getvalue())
    return scanned


def unpacked(path: Path) -> dict[str, bytes]:
    with zipfile.ZipFile(path) as z:
        return {n: z.read(n) for n in z.namelist()}


def unpack_model(spark: SparkSession, path: Path) -> L.Fitted:
    return L.from_files(spark, unpacked(path))


@dataclass(frozen=True)
class Predictor:
    """A published model with its threshold; what it says of one text, of a mail, of many rows."""

    model: L.Fitted
    manifest: dict
    folder: Path

    @classmethod
    def load(cls, spark: SparkSession, config: Config, artifact: str | Path | None = None) -> Predictor:
        folder = files.resolve_artifact(config.artifacts_dir, artifact, config.root)
        manifest = load_json(folder / "manifest.json")
        path = folder / manifest["model_file"]
        if files.file_sha256(path) != manifest["model_sha256"]:
            raise files.ReleaseError("the model isn't the one of the manifest")
        return cls(unpack_model(spark, path), manifest, folder)

    @property
    def threshold(self) -> float:
        return float(self.manifest["threshold"])

    @property
    def version(self) -> str:
        return self.manifest["model_version"]

    def predict_rows(self, rows: DataFrame, key: str = "row_id") -> DataFrame:
        """rows: key, raw_text."""
        return L.predict(self.model, rows, self.threshold, self.version, int(self.manifest["max_text_chars"]), key)

    def predict_text(self, text: str) -> dict:
        if not text.strip():
            raise ValueError("the message is empty")
        rows = SparkSession.active().createDataFrame([("0", text)], "row_id string, raw_text string")
        found = self.predict_rows(rows).first().asDict()
        found.pop("row_id")
        return found

    def predict_mail(self, raw: bytes) -> dict:
        return self.predict_text(message_text(raw))

    def score(self, rows: DataFrame, key: str = "row_id") -> DataFrame:
        """rows: key, text (prepared). Adds score."""
        return L.score(self.model, rows, key)


def split(rows: DataFrame, config: Config) -> DataFrame:
    placed = materialised(
        D.with_splits(
            rows, wanted=config.group_folds, sizes=(config.train_folds, config.validation_folds, config.test_folds), shares=(config.validation_fraction, config.test_fraction), seed=config.random_seed
        )
    )
    D.verify_splits(placed)
    return placed


def _parts(placed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(placed.where(F.col("split") == s).drop("split", "split_fold") for s in ("train", "validation", "test"))


def _judged(scored: DataFrame, threshold: float, slices: Sequence[str] = ("source",)) -> dict:
    return R.metrics_tree(scored, threshold, [s for s in slices if s in scored.columns])


def _fingerprint(path: Path) -> str | None:
    return files.file_sha256(path) if path.is_file() else None


def train(spark: SparkSession, config: Config, rows: DataFrame, audit: dict, *, candidates: Sequence[str] = R.CANDIDATES, repetitions: int | None = None, key: str = "row_id", run: str | None = None) -> dict:
    """Split, compare candidates by grouped cross-validation and on the validation rows, choose, refit, judge once on the
    test rows, and publish: reports, model, manifest, pointer. The manifest."""
    run = run or datetime.now(UTC).strftime("%Y%m%dT%H%M%SZ")
    artifact, reports = config.artifacts_dir / run, config.reports_dir / run
    placed = split(rows, config)
    train_rows, validation, test = _parts(placed)
    cv = materialised(R.cross_validate(train_rows, candidates, repetitions=repetitions or config.cv_repetitions, folds=config.cv_folds, seed=config.random_seed, key=key))
    fold_rows = [r.asDict() for r in cv.orderBy("repetition", "fold", "candidate").collect()]
    summary = [r.asDict() for r in R.summarise(cv).collect()]
    best = M.select_with_tolerance(R.summarise(cv).select("candidate", F.col("mean_macro_f1").alias("macro_f1"), F.col("mean_recall").alias("recall"), "simplicity"), config.selection_tolerance).first().candidate
    table = R.holdout(train_rows, validation, candidates, key)
    chosen = next(r for r in table if r["candidate"] == best)
    model = L.fit_candidate(best, materialised(train_rows.unionByName(validation)), key=key)
    began = time.perf_counter()
    scored = materialised(L.score(model, test, key).drop("text"))
    seconds = time.perf_counter() - began
    judged = _judged(scored, chosen["threshold"])
    judged |= {"batch_prediction_seconds": seconds, "milliseconds_per_message": 1000 * seconds / judged["rows"]}
    crossed = [r.asDict() for r in R.cross_source(rows, best, chosen["threshold"], key).collect()]

    sizes = {f"{r.split}:{r.source}:{r.label}": r["count"] for r in placed.groupBy("split", "source", "label").count().collect()}
    method = {"method": "similarity groups, stratified by source and label", "rows": sizes}
    save_json(reports / "data_audit.json", audit)
    save_json(reports / "split_summary.json", method)
    placed.select("split", key, "label", "source", "similarity_group", "split_fold").write.mode("overwrite").parquet((reports / "split_assignments").as_uri())
    save_csv(reports / "grouped_cv_folds.csv", fold_rows)
    save_csv(reports / "grouped_cv_summary.csv", summary)
    save_csv(reports / "candidate_metrics.csv", table)
    save_json(reports / "metrics.json", {"run_id": run, "selected_model": best, "selected_backend": "classical", "selection_threshold": chosen["threshold"], "candidate_metrics": table, "test_metrics": judged, "cross_source_diagnostic": crossed, "grouped_cv_selection": summary})
    scanned = pack_model(spark, model, artifact / MODEL_FILE)
    return publish(config, run, best, chosen, judged, MON.baseline_of(scored, chosen["threshold"], [s for s in SLICES if s in scored.columns], config.calibration_bins, judged["macro_f1"]), scanned, audit, method)


def publish(config: Config, run: str, selected: str, chosen: dict, judged: dict, baseline: MON.Baseline, scanned: dict, audit: dict, method: dict) -> dict:
    """Write the manifest of a run whose model and reports are there, and point to it."""
    artifact, reports = config.artifacts_dir / run, config.reports_dir / run
    calibration = ("brier_score", "log_loss", "expected_calibration_error")
    versions = {}
    for name in PACKAGES:
        try:
            versions[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            versions[name] = None
    manifest = {
        "schema_version": 2,
        "model_version": run,
        "created_at": _now(),
        "backend": "classical",
        "selected_model": selected,
        "threshold": chosen["threshold"],
        "positive_class": 1,
        "labels": {"0": "safe", "1": "phishing"},
        "max_text_chars": config.max_text_chars,
        "max_request_bytes": config.max_request_bytes,
        "ensemble": None,
        "test_metrics": judged,
        "calibration": {"method": "group-aware sigmoid" if selected.endswith("svm") else "native probability", "validation": {k: chosen[k] for k in calibration}, "untouched_test": {k: judged[k] for k in calibration}},
        "grouping": {**audit.get("near_duplicate_grouping", {}), "split_method": method["method"]},
        "monitoring_baseline": json.loads(baseline.to_json()),
        "privacy_scan": scanned,
        "dataset_fingerprints": {p.name: _fingerprint(p) for p in (config.phishing_dataset, config.ceas_dataset)},
        "dataset_manifest": {"path": "config/datasets.v1.json", "sha256": _fingerprint(config.root / "config" / "datasets.v1.json")},
        "dependency_lock": {"path": "requirements.lock", "sha256": _fingerprint(config.root / "requirements.lock")},
        "report_hashes": {p.name: files.file_sha256(p) for p in sorted(reports.iterdir()) if p.is_file()},
        "config": config.as_json(),
        "runtime": {"python": sys.version, "platform": platform.platform(), "packages": versions},
        "model_file": MODEL_FILE,
        "model_sha256": files.file_sha256(artifact / MODEL_FILE),
    }
    save_json(artifact / "manifest.json", manifest)
    save_json(config.artifacts_dir / "latest.json", {"artifact": run, "updated_at": _now()})
    return manifest


def recover(spark: SparkSession, config: Config, run: str, rows: DataFrame, audit: dict, key: str = "row_id") -> dict:
    """Publish a run that ended before its manifest: split again, score the test rows again, and go on only if the
    metrics are those that the run reported."""
    artifact, reports = config.artifacts_dir / run, config.reports_dir / run
    report = load_json(reports / "metrics.json")
    if (artifact / "manifest.json").is_file():
        raise files.ReleaseError(f"{run} is published")
    placed = split(rows, config)
    _, _, test = _parts(placed)
    scored = materialised(L.score(unpack_model(spark, artifact / MODEL_FILE), test, key).drop("text"))
    judged, told = _judged(scored, report["selection_threshold"]), report["test_metrics"]
    off = [k for k in GATED if (judged[k] is None) != (told[k] is None) or judged[k] is not None and abs(judged[k] - told[k]) > TOLERANCE]
    if off:
        raise files.ReleaseError(f"these metrics differ from those of the run: {off}")
    chosen = next(r for r in report["candidate_metrics"] if r["candidate"] == report["selected_model"])
    baseline = MON.baseline_of(scored, chosen["threshold"], [s for s in SLICES if s in scored.columns], config.calibration_bins, judged["macro_f1"])
    scanned = scan_bytes(spark, unpacked(artifact / MODEL_FILE))
    return publish(config, run, report["selected_model"], chosen, told, baseline, scanned, audit, load_json(reports / "split_summary.json"))


def period(timestamp) -> F.Column:
    """The period of a dated row; what has no date or another one has its own name."""
    year, out = F.year(timestamp), F.lit("date_missing_or_outside_range")
    for low, high in PERIODS:
        out = F.when(year.between(low, high), f"{low}-{high}" if low != high else str(low)).otherwise(out)
    return out


def generalization_report(spark: SparkSession, config: Config, rows: DataFrame, audit: dict, *, artifact: str | None = None, external: DataFrame | None = None, external_path: Path | None = None, key: str = "row_id") -> Path:
    """Metrics, slices, perturbations and calibration of a published run, and once only of a blind corpus.

    external: the rows of the blind corpus in external_path, as `external_corpus` reads them. A second run with one is refused.
    """
    predictor = Predictor.load(spark, config, artifact)
    run, reports, threshold = predictor.version, config.reports_dir / predictor.version, predictor.threshold
    if external is not None and (reports / files.LOCK).is_file():
        raise files.ReleaseError("the external evaluation has run already")
    train_rows, validation, test = _parts(split(rows, config))
    # validation rows are judged by a model that hasn't seen them
    fitted = L.fit_candidate(predictor.manifest["selected_model"], train_rows, key=key)
    scored = {"validation": materialised(L.score(fitted, validation, key)), "untouched_test": materialised(predictor.score(test, key))}
    trees = {n: _judged(df, threshold, SLICES) for n, df in scored.items()}
    slices = {n: t.pop("slices") for n, t in trees.items()}
    payload = {
        "schema_version": 1,
        "run_id": run,
        "generated_at": _now(),
        "selection_isolation": {"untouched_test_used_for_selection": False, "external_used_for_selection": False, "grouped_cv_source": "grouped_cv_summary.csv"},
        "near_duplicate_grouping": audit.get("near_duplicate_grouping"),
        "split_method": predictor.manifest["grouping"]["split_method"],
        "slices": slices,
        "robustness_perturbations": {r.perturbation: r.asDict() for r in R.perturbations(fitted, validation, threshold, key).collect()},
        **trees,
    }
    if external is not None:
        told = materialised(predictor.score(external, key).withColumn("period", period("timestamp")))
        by = lambda columns, least: R.metrics_tree(told, threshold, [c for c in columns if c in told.columns], least)["slices"]
        overall = _judged(told, threshold, ())
        overall.pop("slices")
        payload["external"] = {
            "sha256": files.file_sha256(external_path),
            "observed_prevalence": told.agg(F.avg(F.col("label").cast("double"))).first()[0],
            "overall": overall,
            "time_periods": by(("period",), 1).get("period", {}),
            "language_drift": by(("language_slice",), 1).get("language_slice", {}),
            "domain_and_campaign_groups": by(("domain_group", "campaign_group"), 20),
            "slices": by(SLICES, 20),
        }
    drawn = {"Validation": trees["validation"]["reliability"], "Untouched test": trees["untouched_test"]["reliability"]}
    if external is not None:
        drawn["External"] = payload["external"]["overall"]["reliability"]
    report, diagram, manifest = reports / "generalization_report.json", reports / "reliability_diagram.svg", predictor.folder / "manifest.json"
    before = files.file_sha256(manifest)
    save_json(report, payload)
    save_whole(diagram, charts.reliability_diagram(drawn).encode())
    changed = load_json(manifest)
    changed["report_hashes"] = changed.get("report_hashes", {}) | {p.name: files.file_sha256(p) for p in (report, diagram)}
    if external is not None:
        files.lock_external(reports, {"artifact": run, "artifact_manifest_sha256_before_report": before, "external_sha256": payload["external"]["sha256"], "evaluated_at": payload["generated_at"], "report_sha256": files.file_sha256(report)})
        changed["external_evaluation"] = {"dataset_sha256": payload["external"]["sha256"], "evaluated_at": payload["generated_at"], "report_sha256": files.file_sha256(report), "used_for_selection": False}
    save_json(manifest, changed)
    return report


def diagnostic_report(spark: SparkSession, config: Config, rows: DataFrame, *, artifact: str | None = None, output: str = "docs/images", shares: Sequence[float] = (0.05, 0.1, 0.25, 0.5, 0.75, 1.0), key: str = "row_id") -> dict:
    """The learning curve of a published run's model, and charts of its metrics."""
    folder = files.resolve_artifact(config.artifacts_dir, artifact, config.root)
    manifest = load_json(folder / "manifest.json")
    run, reports = manifest["model_version"], config.reports_dir / manifest["model_version"]
    report, table = load_json(reports / "metrics.json"), load_csv(reports / "candidate_metrics.csv")
    train_rows, validation, _ = _parts(split(rows, config))
    curve = [r.asDict() for r in R.learning_curve(train_rows, validation, manifest["selected_model"], shares, float(manifest["threshold"]), key).collect()]
    save_csv(reports / "learning_curve.csv", curve)
    test, when = report["test_metrics"], shown_time(run)
    to = (config.root / output).resolve()
    drawn = {
        "learning_curve.svg": charts.learning_curve_chart(curve),
        "validation_model_comparison.svg": charts.bar_chart(f"Validation macro F1, {when}", {shown_name(r["candidate"]): r["macro_f1"] for r in table}),
        "test_confusion_matrix.svg": charts.confusion_chart(*(test[c] for c in ("tn", "fp", "fn", "tp"))),
        "test_metrics_by_source.svg": charts.bar_chart(f"Test macro F1 by source, {when}", {shown_name(s): m["macro_f1"] for s, m in test["slices"].get("source", {}).items()}),
    }
    for name, svg in drawn.items():
        save_whole(to / name, svg.encode())
    summary = {"run_id": run, "selected_model": manifest["selected_model"], "threshold": manifest["threshold"], "fractions": list(shares), "charts": sorted(drawn)}
    save_json(reports / "diagnostic_summary.json", summary)
    return summary


def cached(spark: SparkSession, folder: Path, digest: str, make) -> DataFrame:
    """The rows that make() gives, from <folder>/<digest> if they were kept there whole before.

    The digest must tell everything that the rows hang on; a folder without a marker of completion is made anew.
    """
    path = folder / digest
    if not (path / "_SUCCESS").is_file():
        shutil.rmtree(path, ignore_errors=True)
        make().write.parquet(path.as_uri())
    return spark.read.parquet(path.as_uri())
