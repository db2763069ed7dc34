"""Mail files and HTML as sources of text."""

from __future__ import annotations

import email
import email.policy
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

HIDDEN = frozenset({"script", "style", "template"})


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.found, self.run = 0, [], []

    def flush(self) -> None:
        if (text := "".join(self.run).strip()):
            self.found.append(text)
        self.run.clear()

    def handle_starttag(self, tag, attrs):
        self.flush()
        self.depth += tag in HIDDEN

    def handle_endtag(self, tag):
        self.flush()
        self.depth -= tag in HIDDEN and self.depth > 0

    def handle_comment(self, data):
        self.flush()

    def handle_data(self, data):
        if not self.depth:
            self.run.append(data)


def visible_text(html: str) -> str:
    """The strings between tags, stripped, joined by one space; scripts, styles and comments are left out."""
    parser = _Visible()
    parser.feed(html)
    parser.close()
    parser.flush()
    return " ".join(parser.found)


def _content(part) -> str:
    try:
        return str(part.get_content())
    except (LookupError, UnicodeError):
        raw = part.get_payload(decode=True) or b""
        try:
            return raw.decode(part.get_content_charset() or "utf-8", "replace")
        except LookupError:
            return raw.decode("utf-8", "replace")


def message_text(raw: bytes) -> str:
    """Subject, a blank line, and the body: plain parts if there are any, else visible text of the HTML parts."""
    if not raw.strip():
        return ""
    message = email.message_from_bytes(raw, policy=email.policy.default)
    leaves = [p for p in message.walk() if not p.is_multipart() and p.get_content_disposition() != "attachment"]
    of = {kind: [_content(p) for p in leaves if p.get_content_type() == kind] for kind in ("text/plain", "text/html")}
    if of["text/plain"]:
        body = "\n".join(of["text/plain"])
    elif of["text/html"]:
        body = "\n".join(map(visible_text, of["text/html"]))
    else:
        body = "" if message.is_multipart() else _content(message)
    subject = str(message.get("subject", "")).strip()
    return f"{subject}\n\n{body}" if subject else body


@F.pandas_udf(S.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else visible_text(h))


@F.pandas_udf(S.StringType())
def mail_to_text(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: None if r is None else message_text(bytes(r)))


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """path, raw_text of every RFC 822 file below a path or matching a glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", mail_to_text(F.col("content")).alias("raw_text"))
