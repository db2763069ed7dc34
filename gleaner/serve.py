"""A small HTTP front to a scoring function: GET /health and POST /api/v1/predict."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from gleaner.sources.mail import message_text

#: text -> label, is_phishing, probability, threshold, model_version
Scorer = Callable[[str], dict]


def request_text(body: bytes, kind: str) -> str:
    """The text of a request: a JSON object with text and maybe subject, or a raw message. ValueError if it has none."""
    if kind.split(";")[0].strip().lower() == "application/json":
        value = json.loads(body)
        if not isinstance(value, dict) or not isinstance(value.get("text"), str):
            raise ValueError("an object with a text is needed")
        subject = value.get("subject") or ""
        text = f"{subject}\n\n{value['text']}" if str(subject).strip() else value["text"]
    else:
        text = message_text(body)
    if not text.strip():
        raise ValueError("the message is empty")
    return text


def answer(method: str, path: str, kind: str, body: bytes | None, scorer: Scorer | None, version: str | None) -> tuple[int, dict]:
    """Status and JSON of a request; body is None if it was too large."""
    if method == "GET" and path == "/health":
        return (200, {"status": "ok", "model_version": version}) if scorer else (503, {"status": "unavailable"})
    if method != "POST" or path != "/api/v1/predict":
        return 404, {"error": "not found"}
    if body is None:
        return 413, {"error": "the message is too large"}
    if scorer is None:
        return 503, {"error": "the model is unavailable"}
    try:
        text = request_text(body, kind)
    except ValueError:
        return 400, {"error": "the message is invalid"}
    return 200, scorer(text)


def server(host: str, port: int, scorer: Scorer | None, version: str | None = None, most_bytes: int = 5_242_880) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def handle_any(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            body = self.rfile.read(size) if size <= most_bytes else None
            status, value = answer(self.command, self.path, self.headers.get("Content-Type", ""), body, scorer, version)
            data = json.dumps(value).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)
            self.close_connection = body is None

        do_GET = do_POST = handle_any

        def log_message(self, *args) -> None:
            """Requests aren't logged: they hold message content."""

    return ThreadingHTTPServer((host, port), Handler)


def spark_scorer(model, threshold: float, version: str, most: int = 100_000) -> Scorer:
    """Score one text at a time through the batch path. For load, score batches with `models.predict` instead."""
    from pyspark.sql import SparkSession

    from gleaner.operators.models import predict

    def scorer(text: str) -> dict:
        rows = SparkSession.active().createDataFrame([("0", text)], "row_id string, raw_text string")
        r = predict(model, rows, threshold, version, most).first().asDict()
        r.pop("row_id")
        return r

    return scorer
