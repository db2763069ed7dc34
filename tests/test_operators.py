import hashlib
import itertools
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import audit as A
from gleaner.operators import folds as D
from gleaner.operators import grouping as G
from gleaner.operators import metrics as M
from gleaner.operators import monitoring as MON
from gleaner.streaming import drift


def test_audit_removes_empty_conflicting_and_repeated(spark):
    rows = [("Hello  World", 0, "b", "b:1"), ("hello world", 0, "a", "a:10"), ("HELLO world", 0, "a", "a:2"), ("  ", 1, "a", "a:3"), (None, 0, "a", "a:4"), ("both", 0, "a", "a:5"), ("Both", 1, "b", "b:6"), ("alone", 1, "b", "b:7")]
    audit = A.audit(spark.createDataFrame(rows, "raw_text string, label int, source string, row_id string"))
    assert {r.row_id for r in audit.clean.collect()} == {"a:10", "b:7"}
    c = audit.counts().first()
    assert (c.empty_count, c.duplicate_count, c.conflicting_row_count, c.conflicting_hash_count) == (2, 2, 2, 1)
    assert {(r.source, r.label, r.rows) for r in A.distribution(audit.clean).collect()} >= {(None, None, 2), ("a", None, 1), ("b", 1, 1)}
    A.check_labels(audit.clean)
    with pytest.raises(ValueError):
        A.check_labels(audit.clean.where("label = 0"))


def test_groups_are_all_pairs_above_the_threshold_and_transitive(spark):
    r = random.Random(3)
    words = [f"w{i}x" for i in range(400)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(6)]
    texts = []
    for b in base:
        for k in range(5):
            c = list(b)
            for _ in range(k):
                c[r.randrange(60)] = r.choice(words)
            texts.append(" ".join(c))
    texts += ["", "one two", "one two"]
    df = spark.createDataFrame([(i, t, f"{i:064x}") for i, t in enumerate(texts)], "id long, text string, text_hash string")
    shingles = {r.id: set(r.shingles) for r in G.shingled(df).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b]) >= 0.85}
    assert {(r.a, r.b) for r in G.exact_pairs(G.hashed(df)).collect()} == want
    groups = G.near_duplicate_groups(df)
    counts = G.near_duplicate_counts(df, groups)
    named = {r.id: r.similarity_group for r in groups.collect()}
    assert all(named[a] == named[b] for a, b in want) and counts.first().verified_pairs == len(want)
    assert {(r.a, r.b) for r in G.verified(G.banded_pairs(G.hashed(df)), G.hashed(df)).collect()} <= want


def test_url_variants_share_a_group(spark):
    body = "please confirm your account today at {} or lose access to all of your saved messages"
    texts = [body.format("http://a.com/x?id=1"), body.format("http://a.com/x?id=2"), "the quarterly report is attached for your review before monday"]
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    df = spark.createDataFrame([(i, t, digests[i]) for i, t in enumerate(texts)], "id long, text string, text_hash string")
    g = {r.id: r.similarity_group for r in G.near_duplicate_groups(df).collect()}
    assert g[0] == g[1] != g[2] and g[0] == "similarity_" + min(digests[:2])[:20]


def corpus(spark, n=400):
    rows = [(i, f"g{i // 2}", ("a", "b")[i % 4 // 2], i // 4 % 2, f"h{i}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, similarity_group string, source string, label int, text_hash string")


def test_splits_leak_nothing_and_hold_all_strata(spark):
    rows = D.with_splits(corpus(spark)).cache()
    D.verify_splits(rows)
    assert rows.count() == 400 and all(r.leaking == 0 for r in D.leaks(rows).collect())
    share = rows.where("split = 'train'").count() / 400
    assert 0.65 <= share <= 0.75
    bad = rows.withColumn("split", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test"))
    with pytest.raises(ValueError):
        D.verify_splits(bad)
    assert D.split_sizes(7, 20, (14, 3, 3), (0.15, 0.15)) == (5, 1, 1)
    with pytest.raises(ValueError):
        D.fold_limit(corpus(spark, 8), 20)
    part = D.stratified_sample(corpus(spark).withColumn("row_id", F.col("doc_id").cast("string")), 0.25)
    assert 60 <= part.count() <= 140


def plain_metrics(y, s, t):
    p = (s >= t).astype(int)
    f = []
    for c in (0, 1):
        if ((y == c) | (p == c)).any():
            tp, wrong = ((y == c) & (p == c)).sum(), (y != p).sum()
            f.append(2 * tp / (2 * tp + wrong))
    return float(np.mean(f))


def test_metrics_match_direct_formulas(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500)
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.25), 0, 1), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    e = M.evaluate(df, 0.5).first()
    assert abs(e.macro_f1 - plain_metrics(y, s, 0.5)) < 1e-12
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(e.roc_auc - auc) < 1e-12
    ap = last = 0.0
    for t in sorted(set(s), reverse=True):
        k = s >= t
        recall = y[k].sum() / y.sum()
        ap, last = ap + (recall - last) * y[k].mean(), recall
    assert abs(e.pr_auc - ap) < 1e-12
    assert abs(e.brier_score - ((s - y) ** 2).mean()) < 1e-12
    sweep = {r.threshold: r.macro_f1 for r in M.threshold_sweep(df).collect()}
    assert len(sweep) == 181 and all(abs(sweep[t] - plain_metrics(y, s, t)) < 1e-12 for t in M.GRID[::7])
    bins = M.reliability(df).orderBy("bin").collect()
    want = np.minimum(np.digitize(s, np.linspace(0, 1, 11)[1:-1]), 9)
    assert [b.rows for b in bins] == np.bincount(want, minlength=10).tolist()


def test_perfect_scores_and_one_class(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)], "label int, score double")
    t, m = M.tune_threshold(df)
    e = M.evaluate(df, t).first()
    assert 0.4 < t <= 0.6 and m["macro_f1"] == 1.0 and (e.tn, e.fp, e.fn, e.tp) == (2, 0, 0, 2)
    one = M.evaluate(df.where("label = 1"), 0.5).first()
    assert one.roc_auc is None and one.macro_f1 == 1.0 and one.false_positive_rate == 0.0
    with pytest.raises(ValueError):
        M.tune_threshold(df.where("label = 1"))


def lines(spark, records):
    return spark.createDataFrame([(json.dumps(r) if not isinstance(r, str) else r, i + 1) for i, r in enumerate(records)], "value string, line long")


GOOD = {"timestamp": "2026-01-01T00:00:00Z", "probability": 0.95, "predicted_label": "phishing"}


def test_monitoring_rules(spark):
    cases = [
        (GOOD, None), (GOOD | {"slices": {"domain": "Ex.com", "x": "1"}}, None), (GOOD | {"Text": "x"}, "forbidden_fields"), ({"timestamp": "2026-01-01", "probability": 0.5}, "missing_fields"),
        (GOOD | {"timestamp": "soon"}, "bad_timestamp"), (GOOD | {"probability": 1.5}, "bad_probability"), (GOOD | {"predicted_label": "maybe"}, "bad_predicted_label"), (GOOD | {"slices": [1]}, "bad_slices"), ("[1]", "not_an_object"), ("{", "not_an_object"),
        (GOOD | {"predicted_label": 0, "probability": 1}, None),
    ]
    got = {r.line: r for r in MON.parsed(lines(spark, [c for c, _ in cases])).collect()}
    assert [got[i + 1].error for i in range(len(cases))] == [e for _, e in cases]
    assert got[2].slices["domain"].startswith("domain_") and got[2].slices["x"] == "1" and got[11].predicted_label == 0
    with pytest.raises(ValueError, match="line 3"):
        MON.validated(lines(spark, [c for c, _ in cases]))
    with pytest.raises(ValueError):
        MON.validated(lines(spark, ["", "  "]))


def test_monitor_alerts_on_drift(spark):
    base = MON.Baseline(M.edges(), [0.1] * 10, 0.5, {"lang": {"en": 1.0}}, 0.5, 0.99)
    rows = MON.validated(lines(spark, [GOOD | {"true_label": 0, "slices": {"lang": "de"}}] * 5))
    report = MON.monitor(rows, base)
    assert report["status"] == "alert" and set(report["alerts"]) == {"score_distribution_drift", "predicted_prevalence_drift", "slice_drift:lang", "performance_degradation"}
    o, e = np.maximum([0] * 9 + [1.0], 1e-6), np.full(10, 0.1)
    assert abs(report["score_population_stability_index"] - ((o - e) * np.log(o / e)).sum()) < 1e-9


def test_streamed_windows_equal_a_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    records = [GOOD | {"timestamp": f"2026-01-0{1 + i % 3}T0{i % 9}:00:00Z", "probability": i / 40} for i in range(40)] + [GOOD | {"timestamp": "2026-02-01T00:00:00Z"}]
    (folder / "a.jsonl").write_text("\n".join(map(json.dumps, records)) + "\nnot json\n")
    from gleaner.sources.lines import read_lines, stream_lines

    base = MON.Baseline(M.edges(), [0.1] * 10, 0.5)
    seen = []
    q = drift.start_monitor(stream_lines(spark, str(folder)), base, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    good = MON.parsed(read_lines(spark, str(folder))).where("error IS NULL")
    want = {r.window_start: round(r.score_psi, 9) for r in drift.window_report(drift.windowed_counts(good), base).collect()}
    got = {r.window_start: round(r.score_psi, 9) for r in seen}
    assert len(got) >= 3 and got.items() <= want.items()


def test_psi_of_equal_histograms_is_nothing(spark):
    r = spark.range(1).select(MON.psi(F.lit(0.2), F.lit(0.2)).alias("p"), MON.psi(F.lit(0.0), F.lit(0.0)).alias("q")).first()
    assert r.p == 0 and r.q == 0 and re.match(MON.ISO.replace(r"\d", "[0-9]"), "2026-01-01T10:00:00.5+01:00")


def test_thresholds_by_group_and_the_ensemble_gate(spark):
    rows = [(0, 0.1, 0.6), (0, 0.2, 0.3), (1, 0.4, 0.7), (1, 0.9, 0.2), (0, 0.45, 0.1), (1, 0.8, 0.9)]
    df = spark.createDataFrame(rows, "label int, first double, second double")
    grid = {r.weight: r for r in M.ensemble_grid(df, (0.0, 0.5, 1.0)).collect()}
    for w, r in grid.items():
        one = df.select("label", (F.lit(w) * F.col("first") + F.lit(1 - w) * F.col("second")).alias("score"))
        assert M.tune_threshold(one) == (r.threshold, {"macro_f1": r.macro_f1, "recall": r.recall})
    table = spark.createDataFrame([(0.25, 0.9, 0.6), (0.5, 0.8, 0.9), (0.75, 0.9, 0.7)], "weight double, macro_f1 double, recall double")
    assert [r.weight for r in M.ensemble_accepted(table, 0.85, 0.7, 0.05).collect()] == [0.75]
    assert M.ensemble_accepted(table, 0.85, 0.8, 0.0).count() == 0  # the best F1 loses recall; no other weight takes its place
    assert M.best_threshold(M.threshold_sweep(df.select("label", F.col("first").alias("score")).limit(0))).count() == 0


def test_many_classes_are_placed_greedily_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(D, "PLAN_ROWS", 40)
    r = random.Random(6)
    # nearly every group is a class of its own
    rows = [(f"g{g}", f"s{r.randrange(2)}", r.randrange(2)) for g in range(260) for _ in range(1 + r.randrange(40))]
    df = spark.createDataFrame(rows, "similarity_group string, source string, label int")
    classes = D.group_classes(df)
    assert classes.select("class").distinct().count() > 100
    fold = {x.similarity_group: x.split_fold for x in D.grouped_folds(df, 5, 1).collect()}
    assert fold.keys() == {g for g, _, _ in rows} and set(fold.values()) == set(range(5))
    total, held = {}, {}
    for g, s, y in rows:
        total[s, y] = total.get((s, y), 0) + 1
        held[fold[g], s, y] = held.get((fold[g], s, y), 0) + 1
    assert all(abs(held.get((f, *k), 0) / n - 0.2) < 0.06 for k, n in total.items() for f in range(5))
    monkeypatch.setattr(D, "PLAN_ROWS", 10**6)  # the same in one part
    assert {x.similarity_group: x.split_fold for x in D.grouped_folds(df, 5, 1).collect()} == fold
