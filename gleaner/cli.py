"""Command line: each command prints JSON and ends with 0."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import functions as F

from gleaner.config import Config, load_config
from gleaner.session import build_session


def clean_corpus(spark, config: Config):
    """Both corpora, audited, grouped, prepared: the canonical rows, and the audit."""
    from gleaner.functions import text as T
    from gleaner.operators import audit as A
    from gleaner.operators.grouping import near_duplicate_counts, near_duplicate_groups
    from gleaner.plans.scratch import materialised
    from gleaner.sources.corpora import corpora

    raw = corpora(spark, str(config.phishing_dataset), str(config.ceas_dataset))
    message = F.concat(F.coalesce("sender", F.lit("")), F.lit("\n"), F.coalesce("raw_text", F.lit("")))
    rules = T.suffix_rules((config.root / config.suffix_rules).read_text(encoding="utf-8").splitlines()) if config.suffix_rules else None
    held = materialised(raw.withColumn("__found", T.domains(message, rules)))
    audit = A.audit(held.withColumns(T.message_metadata(message, F.col("__found"))).drop("__found", "sender"))
    clean = materialised(audit.clean)
    A.check_labels(clean)
    named = clean.select(F.col("row_id").alias("id"), "text", "text_hash")
    groups = materialised(near_duplicate_groups(named, config.near_duplicate_jaccard))
    counts = near_duplicate_counts(named, groups, config.near_duplicate_jaccard)
    prepared = clean.withColumn("__p", T.prepare_text(F.col("text"), config.max_text_chars)).withColumns({"text": F.col("__p.text"), "was_truncated": F.col("__p.was_truncated")})
    rows = prepared.join(groups.withColumnRenamed("id", "row_id"), "row_id")
    order = "text label source row_id text_hash similarity_group was_truncated timestamp length_slice has_html has_url has_obfuscation attachment_slice language_slice domain_group campaign_group".split()
    return materialised(rows.select(*order)), audit, counts


def audit_report(rows, audit, counts) -> dict:
    from gleaner.operators.audit import distribution

    shown = lambda df: [r.asDict() for r in df.collect()]
    return {
        "clean": shown(distribution(rows)),
        "raw": shown(distribution(audit.rows)),
        "removed": audit.counts().first().asDict(),
        "truncated_count": rows.where("was_truncated").count(),
        "near_duplicate_grouping": counts.first().asDict() | {"jaccard_threshold": 0.85},
    }


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="gleaner")
    commands = parser.add_subparsers(dest="command", required=True)
    artifact = ("--artifact", {})
    options = {
        "fetch-data": [("--accept-licenses", {"action": "store_true"}), ("--external", {"action": "store_true"})],
        "audit": [],
        "train": [("--repetitions", {"type": int}), ("--candidates", {"nargs": "+"}), ("--run", {})],
        "recover": [("--run", {"required": True})],
        "predict": [("--file", {"required": True}), artifact],
        "serve": [artifact, ("--host", {}), ("--port", {"type": int})],
        "report": [artifact, ("--output", {"default": "docs/images"})],
        "generalization-report": [artifact, ("--external-path", {})],
        "monitor": [("--input", {"required": True}), artifact, ("--output", {})],
        "promote": [artifact, ("--rollback", {"action": "store_true"})],
        "package-release": [("--artifact", {"required": True}), ("--version", {"default": "v1.0.0"}), ("--output", {"default": "release"})],
    }
    for name, own in options.items():
        sub = commands.add_parser(name)
        sub.add_argument("--config", default="config/config.json")
        for flag, how in own:
            sub.add_argument(flag, **how)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    config = load_config(args.config)
    print(json.dumps(run(args, config), indent=2, default=str))
    return 0


def _fetch(spark, args, config) -> dict:
    from gleaner.plans import files

    return {"datasets": files.fetch_data(config.root, config.root / "config" / "datasets.v1.json", accept_licenses=args.accept_licenses, external=args.external)}


def _predict(spark, args, config) -> dict:
    from gleaner.plans.runs import Predictor

    return Predictor.load(spark, config, args.artifact).predict_mail(Path(args.file).read_bytes())


def _serve(spark, args, config) -> dict:
    from gleaner.plans.runs import Predictor
    from gleaner.serve import server

    predictor = Predictor.load(spark, config, args.artifact)
    with server(args.host or config.host, args.port or config.port, predictor.predict_text, predictor.version, config.max_request_bytes) as front:
        front.serve_forever()
    return {"status": "stopped"}


def _monitor(spark, args, config) -> dict:
    from gleaner.operators import monitoring as MON
    from gleaner.plans import files
    from gleaner.plans.reports import load_json, save_json
    from gleaner.sources.lines import read_lines

    folder = files.resolve_artifact(config.artifacts_dir, args.artifact, config.root)
    report = MON.monitor(MON.validated(read_lines(spark, args.input)), MON.Baseline(**load_json(folder / "manifest.json")["monitoring_baseline"]))
    if args.output:
        save_json(Path(args.output), report)
    return report


def _release(spark, args, config) -> dict:
    from gleaner.plans import files
    from gleaner.plans.privacy import scan_folder

    where = (config.root, config.artifacts_dir, config.reports_dir, lambda folder: scan_folder(spark, str(folder)))
    if args.command == "promote":
        return files.promote(*where, artifact=args.artifact, rollback=args.rollback)
    return files.package_release(*where, artifact=args.artifact, version=args.version, output=args.output)


def _with_corpus(spark, args, config) -> dict:
    """The commands that read the corpora."""
    from gleaner.plans import runs
    from gleaner.plans.reports import save_json

    rows, found, counts = clean_corpus(spark, config)
    audit = audit_report(rows, found, counts)
    if args.command == "audit":
        save_json(config.reports_dir / "data_audit.json", audit)
        return audit
    if args.command == "train":
        from gleaner.plans.training import CANDIDATES

        return runs.train(spark, config, rows, audit, candidates=args.candidates or CANDIDATES, repetitions=args.repetitions, run=args.run)
    if args.command == "recover":
        return runs.recover(spark, config, args.run, rows, audit)
    if args.command == "report":
        return runs.diagnostic_report(spark, config, rows, artifact=args.artifact, output=args.output)
    path, external = None, None
    if args.external_path:
        from gleaner.sources.corpora import external_corpus

        path = Path(args.external_path).resolve()
        external = external_corpus(spark, path.as_uri(), most=config.max_text_chars)
    return {"report": str(runs.generalization_report(spark, config, rows, audit, artifact=args.artifact, external=external, external_path=path))}


COMMANDS = {"fetch-data": _fetch, "predict": _predict, "serve": _serve, "monitor": _monitor, "promote": _release, "package-release": _release}


def run(args: argparse.Namespace, config: Config) -> dict:
    spark = None if args.command == "fetch-data" else build_session("gleaner")
    return COMMANDS.get(args.command, _with_corpus)(spark, args, config)


if __name__ == "__main__":
    raise SystemExit(main())
