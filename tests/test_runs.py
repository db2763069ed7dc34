import csv
import json
import random
import threading
import urllib.request
import zipfile

import pytest

from gleaner import cli
from gleaner.config import load_config
from gleaner.plans import files, reports, runs

WORDS = (["invoice", "meeting", "agenda", "project", "lunch", "minutes"], ["winner", "verify", "password", "urgent", "prize", "click"])


def project(root, n=48):
    r = random.Random(5)
    for d in ("data", "config"):
        (root / d).mkdir()
    text = lambda k, y: " ".join(r.choice([*WORDS[y], "hello", "today"]) for _ in range(14)) + f" u{k}q{r.randrange(10**5)} z{k}{y} {' '.join(f'n{r.randrange(900)}' for _ in range(10))}"
    with open(root / "data/a.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Email Text", "Email Type"])
        w.writerows([text(i, i % 2), ("Safe Email", "Phishing Email")[i % 2]] for i in range(n))
    with open(root / "data/b.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["subject", "body", "label"])
        w.writerows([f"s{i}", text(n + i, i % 2), i % 2] for i in range(n))
    with open(root / "data/x.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["subject", "body", "date", "Label"])
        w.writerows([f"s{i}", text(3 * n + i, i % 2), f"202{4 + i % 2}-01-05", i % 2] for i in range(20))
    for name in files.RELEASED_DOCUMENTS:
        (root / name).write_text(name)
    (root / "config/datasets.v1.json").write_text("{}"), (root / "requirements.lock").write_text("x==1")
    raw = {
        "data": {"phishing_email": "data/a.csv", "ceas_08": "data/b.csv"}, "paths": {"artifacts": "artifacts", "reports": "reports"},
        "splits": {"train": 0.6, "validation": 0.2, "test": 0.2, "group_folds": 5, "train_folds": 3, "validation_folds": 1, "test_folds": 1}, "generalization": {"cv_repetitions": 1, "cv_folds": 2},
        "max_text_chars": 1000, "max_request_bytes": 5000, "classical": {"min_document_frequency": 1},
    }
    (root / "config/config.json").write_text(json.dumps(raw))
    return root / "config/config.json"


def command(path, *argv):
    args = cli._parser().parse_args([*argv, "--config", str(path)])
    return cli.run(args, load_config(path))


def test_a_run_is_trained_published_judged_and_predicts(spark, tmp_path):
    path = project(tmp_path)
    config = load_config(path)
    manifest = command(path, "train", "--run", "20260102T030405Z", "--candidates", "complement_nb", "word_logistic")
    run = manifest["model_version"]
    assert {p.name for p in (tmp_path / "reports" / run).iterdir() if p.is_file()} == set(manifest["report_hashes"])
    table = reports.load_csv(tmp_path / "reports" / run / "candidate_metrics.csv")
    assert [r["macro_f1"] for r in table] == sorted((r["macro_f1"] for r in table), reverse=True) and {r["candidate"] for r in table} == {"majority", "complement_nb", "word_logistic"}
    assert manifest["test_metrics"]["macro_f1"] > 0.8 and manifest["privacy_scan"]["status"] == "passed" and len(manifest["monitoring_baseline"]["score_bin_fractions"]) == 10
    assert json.loads((tmp_path / "artifacts/latest.json").read_text())["artifact"] == run

    # a run that lost its manifest is recovered only with the same metrics
    kept = (tmp_path / "artifacts" / run / "manifest.json").read_text()
    (tmp_path / "artifacts" / run / "manifest.json").unlink()
    report = reports.load_json(tmp_path / "reports" / run / "metrics.json")
    reports.save_json(tmp_path / "reports" / run / "metrics.json", report | {"test_metrics": report["test_metrics"] | {"recall": report["test_metrics"]["recall"] + 1e-9}})
    with pytest.raises(files.ReleaseError, match="recall"):
        command(path, "recover", "--run", run)
    reports.save_json(tmp_path / "reports" / run / "metrics.json", report)
    again = command(path, "recover", "--run", run)
    assert {k: again[k] for k in ("threshold", "model_sha256", "selected_model", "report_hashes")} == {k: json.loads(kept)[k] for k in ("threshold", "model_sha256", "selected_model", "report_hashes")}

    mail = tmp_path / "m.eml"
    mail.write_bytes(b"Subject: urgent\n\nwinner verify password prize click urgent winner verify\n")
    told = command(path, "predict", "--file", str(mail))
    assert told["label"] == "phishing" and told["is_phishing"] and told["model_version"] == run and 0 <= told["probability"] <= 1
    predictor = runs.Predictor.load(spark, config)
    assert predictor.predict_text("meeting agenda project lunch minutes invoice")["label"] == "safe"
    with pytest.raises(ValueError):
        predictor.predict_text("  ")

    front = cli_server(predictor)
    with urllib.request.urlopen(f"http://127.0.0.1:{front.server_port}/health") as r:
        assert json.load(r)["model_version"] == run
    front.shutdown(), front.server_close()

    where = (tmp_path, config.artifacts_dir, config.reports_dir)
    out = command(path, "generalization-report", "--external-path", str(tmp_path / "data/x.csv"))
    payload = json.loads(open(out["report"]).read())
    assert set(payload["robustness_perturbations"]) == {"whitespace", "homoglyph", "url_query", "call_to_action"}
    assert {k: v["rows"] for k, v in payload["external"]["time_periods"].items()} == {"2024": 10, "2025": 10} and payload["untouched_test"]["macro_f1"] == manifest["test_metrics"]["macro_f1"]
    with pytest.raises(files.ReleaseError, match="already"):
        command(path, "generalization-report", "--external-path", str(tmp_path / "data/x.csv"))
    summary = command(path, "report")
    assert all((tmp_path / "docs/images" / n).read_text().startswith("<svg") for n in summary["charts"]) and len(summary["charts"]) == 4
    assert len(reports.load_csv(tmp_path / "reports" / run / "learning_curve.csv")) == 6

    assert command(path, "promote", "--artifact", run)["artifact"] == run
    packed = command(path, "package-release", "--artifact", run)
    with zipfile.ZipFile(packed["archive"]) as z:
        assert any(n.endswith("model.zip") for n in z.namelist())
    assert files.resolve_artifact(where[1]).name == run

    lines = tmp_path / "batch.jsonl"
    lines.write_text("\n".join(json.dumps({"timestamp": "2026-01-01T00:00:00Z", "probability": 0.99, "predicted_label": "phishing"}) for _ in range(30)))
    assert command(path, "monitor", "--input", str(lines))["status"] == "alert"


def cli_server(predictor):
    from gleaner.serve import server

    front = server("127.0.0.1", 0, predictor.predict_text, predictor.version)
    threading.Thread(target=front.serve_forever, daemon=True).start()
    return front


def test_small_files_and_names(spark, tmp_path):
    rows = [{"a": 1.5, "b": "x,y", "c": None}, {"a": 2.0, "b": 'q"', "c": 3.0}]
    reports.save_csv(tmp_path / "t.csv", rows)
    assert reports.load_csv(tmp_path / "t.csv") == rows
    assert reports.shown_time("20260102T030405Z") == "02 Jan 2026, 03:04 UTC" and reports.shown_time("x") == "x"
    assert reports.shown_name("word_char_svm") == "Word and character linear SVM" and reports.shown_name("own_source") == "Own source"
    made = []
    for _ in range(2):
        df = runs.cached(spark, tmp_path / "cache", "d1", lambda: made.append(1) or spark.range(5).toDF("x"))
        assert df.count() == 5
    assert len(made) == 1
    with pytest.raises(files.ProvenanceError):
        files.install(b"a", tmp_path / "f", "0" * 64, 1)
    assert not (tmp_path / "f").exists()


def test_svm_is_calibrated_on_grouped_folds(spark):
    from gleaner.operators import models as L

    r = random.Random(0)
    rows = [(f"r{i}", " ".join(r.choice([*WORDS[i % 2], "hello"]) for _ in range(12)), i % 2, f"g{i}", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id string, text string, label int, similarity_group string, source string")
    model = L.fit_candidate("word_char_svm", df, key="row_id", least=1)
    assert len(model.stages) == 3
    told = L.score(model, df, "row_id").collect()
    assert sum((x.score >= 0.5) == (x.label == 1) for x in told) >= 57 and all(0 <= x.score <= 1 for x in told)
    few = df.where("row_id in ('r0', 'r1')")
    with pytest.raises(ValueError):
        L.fit_candidate("word_char_svm", few, key="row_id", least=1)
