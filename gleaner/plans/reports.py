"""Small results as files: JSON and CSV that are whole or not there, names and times as readers see them."""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime
from pathlib import Path

# What candidates and sources are called in charts.
NAMES = {
    "majority": "Majority baseline",
    "complement_nb": "Complement naive Bayes",
    "word_logistic": "Word logistic regression",
    "word_char_logistic": "Word and character logistic regression",
    "word_char_svm": "Word and character linear SVM",
    "phishing_email": "Phishing Email",
    "ceas_08": "CEAS 2008",
}


def save_whole(path: Path, data: bytes) -> None:
    """Readers see the old file or the new one, never a part."""
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.parent / f".{uuid.uuid4().hex}.part"
    try:
        part.write_bytes(data)
        os.replace(part, path)
    finally:
        part.unlink(missing_ok=True)


def save_json(path: Path, value) -> None:
    save_whole(path, json.dumps(value, indent=2, sort_keys=True, default=str).encode())


def load_json(path: Path) -> dict:
    return json.loads(path.read_text(encoding="utf-8"))


def save_csv(path: Path, rows: Sequence[Mapping], columns: Sequence[str] | None = None) -> None:
    """A table that fits on the driver: metrics by fold, by candidate, by share."""
    out = io.StringIO()
    writer = csv.DictWriter(out, columns or list(rows[0]), extrasaction="ignore", lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    save_whole(path, out.getvalue().encode())


def load_csv(path: Path) -> list[dict]:
    """The rows of save_csv, numbers as numbers."""

    def value(text: str):
        try:
            return float(text) if text else None
        except ValueError:
            return text

    with open(path, encoding="utf-8", newline="") as f:
        return [{k: value(v) for k, v in r.items()} for r in csv.DictReader(f)]


def shown_name(name: str) -> str:
    return NAMES.get(name, name.replace("_", " ").strip().capitalize())


def shown_time(run: str) -> str:
    """The time in a run's name, as readers see it; other names stay as they are."""
    try:
        return datetime.strptime(run[:16], "%Y%m%dT%H%M%SZ").replace(tzinfo=UTC).strftime("%d %b %Y, %H:%M UTC")
    except ValueError:
        return run
