import email.message
import hashlib
import json
import zipfile

import pytest

from gleaner.config import load_config
from gleaner.plans import charts, files
from gleaner.plans.privacy import PrivacyError, scan_folder
from gleaner.sources import corpora as C
from gleaner.sources.lines import read_lines
from gleaner.sources.mail import message_text, read_mail, visible_text


def test_corpora_come_to_one_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Email Text,Email Type,extra\n"two\nlines, ""quoted""",Safe Email,1\nhi,Phishing Email,2\n,Safe Email,3\n')
    (tmp_path / "b.csv").write_text('subject,body,label,date\nHello,  the  body ,1,"Tue, 05 Aug 2008 16:31:02 -0700"\n,only body,0,never\n')
    rows = {r.row_id: r for r in C.corpora(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv")).collect()}
    assert rows["phishing_email:0"].raw_text == 'two\nlines, "quoted"' and rows["phishing_email:1"].label == 1
    assert rows["ceas_08:0"].raw_text == "Hello\n\nthe body" and rows["ceas_08:1"].raw_text == "only body"
    assert str(rows["ceas_08:0"].timestamp) == "2008-08-05 23:31:02" and rows["ceas_08:1"].timestamp is None
    (tmp_path / "c.csv").write_text("Email Text,Email Type\nx,Other\n")
    with pytest.raises(ValueError, match="unknown"):
        C.message_corpus(spark, str(tmp_path / "c.csv"))


def test_external_corpus_checks_and_hides_content(spark, tmp_path):
    lines = ["Subject, BODY ,Date,Attachments_Count,Label"] + [f"s{i},b{i},2025-01-0{1 + i % 9},{i % 2},{i % 3 == 0:d}" for i in range(30)]
    (tmp_path / "x.csv").write_text("﻿" + "\n".join(lines), encoding="utf-8")
    df = C.external_corpus(spark, str(tmp_path / "x.csv"), rows_expected=30, positives_expected=10)
    rows = df.collect()
    assert len(rows) == 30 and {r.attachment_slice for r in rows} == {"has_attachment", "no_attachment"} and not {"raw_text", "sender"} & set(df.columns)
    assert rows[0].row_id.startswith("external:") and len(rows[0].row_id) == 29
    with pytest.raises(ValueError):
        C.external_corpus(spark, str(tmp_path / "x.csv"), rows_expected=31)


def test_mail_prefers_plain_parts(spark, tmp_path):
    m = email.message.EmailMessage()
    m["Subject"] = "Hi"
    m.set_content("<p>Hello <b>you</b></p><script>no()</script><!-- no -->", subtype="html")
    m.add_attachment(b"secret", maintype="text", subtype="plain", filename="a.txt")
    (tmp_path / "m.eml").write_bytes(bytes(m))
    assert [r.raw_text for r in read_mail(spark, str(tmp_path)).collect()] == ["Hi\n\nHello you"]
    assert message_text(b" \n") == "" and message_text(b"Subject: s\n\nplain\n") == "s\n\nplain\n"
    assert visible_text("a<br>b &amp; c") == "a b & c"


def test_lines_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "l.txt").write_text("\n".join(f"x{i}" for i in range(50)))
    assert all(r.value == f"x{r.line - 1}" for r in read_lines(spark, str(tmp_path / "l.txt")).collect())


def config_file(root, **more):
    raw = {"data": {"phishing_email": "data/a.csv", "ceas_08": "data/b.csv"}, "paths": {"artifacts": "artifacts", "reports": "reports"}, "splits": {"train": 0.7, "validation": 0.15, "test": 0.15}} | more
    (root / "config").mkdir(exist_ok=True)
    (root / "config" / "config.json").write_text(json.dumps(raw))
    return root / "config" / "config.json"


def test_config_rules(tmp_path):
    c = load_config(config_file(tmp_path))
    assert c.phishing_dataset == (tmp_path / "data/a.csv").resolve() and c.group_folds == 20 and c.as_json()["artifacts_dir"] == "artifacts"
    for bad in ({"max_text_chars": 10}, {"splits": {"train": 0.5, "validation": 0.1, "test": 0.1}}, {"generalization": {"minhash_permutations": 64}}, {"data": {}}):
        with pytest.raises(ValueError):
            load_config(config_file(tmp_path, **bad))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_fetch_installs_verified_files_only(tmp_path):
    raw, lf = b"a,b\r\n1,2\r\n", b"a,b\n1,2\n"
    with zipfile.ZipFile(tmp_path / "src.zip", "w") as z:
        z.writestr("d/x.csv", raw)
    packed = (tmp_path / "src.zip").read_bytes()
    member = {"archive_path": "d/x.csv", "destination": "data/x.csv", "source_sha256": sha(raw), "source_bytes": len(raw), "sha256": sha(lf), "bytes": len(lf), "normalization": "crlf_to_lf"}
    entry = {"id": "d", "download_url": (tmp_path / "src.zip").as_uri(), "archive_sha256": sha(packed), "archive_bytes": len(packed), "members": [member]}
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"schema_version": 1, "policy": {"license_acceptance_required": True}, "datasets": [entry]}))
    with pytest.raises(files.ProvenanceError):
        files.fetch_data(tmp_path, manifest, accept_licenses=False)
    assert files.fetch_data(tmp_path, manifest, accept_licenses=True)[0]["status"] == "installed"
    assert (tmp_path / "data/x.csv").read_bytes() == lf
    assert files.fetch_data(tmp_path, manifest, accept_licenses=True)[0]["status"] == "verified_existing"
    (tmp_path / "data/x.csv").write_text("other")
    with pytest.raises(files.ProvenanceError):
        files.fetch_data(tmp_path, manifest, accept_licenses=True)
    for bad in ("/etc/x", "../x", "a/../../x"):
        with pytest.raises(files.ProvenanceError):
            files.inside(tmp_path, bad)


def artifact(root, name):
    a, r = root / "artifacts" / name, root / "reports" / name
    a.mkdir(parents=True), r.mkdir(parents=True), (root / "config").mkdir(exist_ok=True)
    (a / "model.joblib").write_bytes(b"model")
    (root / "config/datasets.v1.json").write_text("{}"), (root / "requirements.lock").write_text("x==1")
    for n in files.RELEASED_REPORTS:
        (r / n).write_text(n)
    for n in files.RELEASED_DOCUMENTS:
        (root / n).write_text(n)
    hashes = {n: files.file_sha256(r / n) for n in files.REQUIRED_REPORTS}
    files.lock_external(r, {"artifact": name, "report_sha256": hashes["generalization_report.json"], "external_sha256": "e"})
    record = {
        "schema_version": 2, "model_version": name, "model_file": "model.joblib", "backend": "classical", "model_sha256": sha(b"model"), "report_hashes": hashes, "external_evaluation": {"dataset_sha256": "e", "used_for_selection": False},
        "dataset_manifest": {"sha256": sha(b"{}")}, "dependency_lock": {"sha256": sha(b"x==1")},
    }
    (a / "manifest.json").write_text(json.dumps(record))


def test_promotion_rollback_and_release(spark, tmp_path):
    artifact(tmp_path, "one"), artifact(tmp_path, "two")
    where = (tmp_path, tmp_path / "artifacts", tmp_path / "reports", lambda folder: scan_folder(spark, str(folder)))
    with pytest.raises(files.ReleaseError):
        files.promote(*where, rollback=True)
    files.promote(*where, artifact="one"), files.promote(*where, artifact="two")
    assert files.resolve_artifact(tmp_path / "artifacts").name == "two"
    assert files.promote(*where, rollback=True)["artifact"] == "one" and files.resolve_artifact(tmp_path / "artifacts").name == "one"
    out = files.package_release(*where, artifact="one")
    with zipfile.ZipFile(out["archive"]) as z:
        assert f"{files.RELEASE_NAME}-v1.0.0/SHA256SUMS" in z.namelist() and z.namelist() == sorted(z.namelist())
    with pytest.raises(files.ReleaseError):
        files.lock_external(tmp_path / "reports" / "one", {})
    assert [p["action"] for p in files.promotions(tmp_path / "artifacts")] == ["promote", "promote", "rollback"]
    (tmp_path / "reports/one/metrics.json").write_text("changed")
    (tmp_path / "requirements.lock").unlink()
    with pytest.raises(files.ReleaseError, match="dependency_lock is missing; files: report metrics.json has another digest"):  # all findings at once
        files.promote(*where, artifact="one")
    assert len(files.promotions(tmp_path / "artifacts")) == 3
    (tmp_path / "artifacts/two/model.joblib").write_bytes(b"someone@example.com")
    with pytest.raises(PrivacyError):
        scan_folder(spark, str(tmp_path / "artifacts/two"))
    (tmp_path / "artifacts/latest.json").write_text(json.dumps({"artifact": "../reports"}))
    with pytest.raises(files.ReleaseError):
        files.resolve_artifact(tmp_path / "artifacts")


def test_charts_are_svg():
    rows = [{"rows": 3, "mean_probability": 0.2, "observed_rate": 0.1}, {"rows": 0, "mean_probability": None, "observed_rate": None}]
    for svg in (charts.reliability_diagram({"test": rows}), charts.confusion_chart(1, 2, 3, 4), charts.bar_chart("Macro F1", {"a": 0.5}), charts.learning_curve_chart([{"share": 1.0, "train_macro_f1": 1.0, "validation_macro_f1": 0.9}])):
        assert svg.startswith("<svg") and svg.endswith("</svg>") and "<title" in svg
