"""Charts as SVG text, drawn from the small tables that metrics give."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html import escape

WIDTH, HEIGHT, MARGIN = 720, 480, 70
INK = ("#2f5d8a", "#b3543a", "#5b7f3a", "#7a5195")


def _svg(title: str, description: str, body: Sequence[str]) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" viewBox="0 0 {WIDTH} {HEIGHT}" role="img" aria-labelledby="t d">'
    return "\n".join([head, f'<title id="t">{escape(title)}</title>', f'<desc id="d">{escape(description)}</desc>', f'<text x="{MARGIN}" y="36" font-size="20">{escape(title)}</text>', *body, "</svg>"])


def _place(x: float, y: float) -> tuple[float, float]:
    """A point of the unit square on the sheet."""
    return MARGIN + x * (WIDTH - 3 * MARGIN), HEIGHT - MARGIN - y * (HEIGHT - 2 * MARGIN)


def _axes(x_name: str, y_name: str) -> list[str]:
    out = []
    for k in range(6):
        (x, bottom), (left, y) = _place(k / 5, 0), _place(0, k / 5)
        out += [f'<text x="{x:.0f}" y="{bottom + 18:.0f}" font-size="11" text-anchor="middle">{k / 5:.1f}</text>', f'<text x="{left - 8:.0f}" y="{y + 4:.0f}" font-size="11" text-anchor="end">{k / 5:.1f}</text>']
    (x0, y0), (x1, y1) = _place(0, 0), _place(1, 1)
    out.append(f'<path d="M{x0:.0f} {y1:.0f}V{y0:.0f}H{x1:.0f}" fill="none" stroke="#555"/>')
    out += [f'<text x="{(x0 + x1) / 2:.0f}" y="{HEIGHT - 20}" text-anchor="middle">{escape(x_name)}</text>', f'<text x="20" y="{(y0 + y1) / 2:.0f}" transform="rotate(-90 20 {(y0 + y1) / 2:.0f})" text-anchor="middle">{escape(y_name)}</text>']
    return out


def _lines(series: Mapping[str, Sequence[tuple[float, float]]]) -> list[str]:
    out = []
    for k, (name, points) in enumerate(series.items()):
        ink, placed = INK[k % len(INK)], [_place(x, y) for x, y in points]
        if placed:
            out.append(f'<polyline points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in placed)}" fill="none" stroke="{ink}" stroke-width="2"/>')
            out += [f'<circle cx="{x:.1f}" cy="{y:.1f}" r="3" fill="{ink}"/>' for x, y in placed]
        out.append(f'<text x="{WIDTH - 2 * MARGIN + 10}" y="{90 + 20 * k}" font-size="12" fill="{ink}">{escape(name)}</text>')
    return out


def reliability_diagram(series: Mapping[str, Sequence[Mapping]]) -> str:
    """series: name -> rows of metrics.reliability; empty bins have no point."""
    points = {n: [(float(r["mean_probability"]), float(r["observed_rate"])) for r in rows if r["rows"]] for n, rows in series.items()}
    (x0, y0), (x1, y1) = _place(0, 0), _place(1, 1)
    diagonal = f'<path d="M{x0:.0f} {y0:.0f}L{x1:.0f} {y1:.0f}" stroke="#999" stroke-dasharray="4 4"/>'
    return _svg("Reliability", "Mean predicted probability against the observed rate.", [*_axes("Mean predicted probability", "Observed rate"), diagonal, *_lines(points)])


def learning_curve_chart(rows: Sequence[Mapping]) -> str:
    points = {n: [(float(r["share"]), float(r[c])) for r in rows] for n, c in (("training", "train_macro_f1"), ("validation", "validation_macro_f1"))}
    return _svg("Learning curve", "Macro F1 by share of the training rows.", [*_axes("Share of training rows", "Macro F1"), *_lines(points)])


def bar_chart(title: str, values: Mapping[str, float]) -> str:
    """One horizontal bar, 0 to 1, for each name."""
    step = (HEIGHT - 2 * MARGIN) / max(1, len(values))
    body = []
    for k, (name, v) in enumerate(values.items()):
        y = MARGIN + k * step
        body += [f'<rect x="200" y="{y:.0f}" width="{max(0.0, min(1.0, v)) * 420:.1f}" height="{step * 0.7:.0f}" fill="{INK[0]}"/>', f'<text x="190" y="{y + step * 0.5:.0f}" text-anchor="end" font-size="12">{escape(name)}</text>', f'<text x="640" y="{y + step * 0.5:.0f}" font-size="12">{v:.3f}</text>']
    return _svg(title, f"{title} by name.", body)


def confusion_chart(tn: int, fp: int, fn: int, tp: int) -> str:
    total = max(1, tn + fp + fn + tp)
    cells = (("safe as safe", tn, 0, 0), ("safe as phishing", fp, 1, 0), ("phishing as safe", fn, 0, 1), ("phishing as phishing", tp, 1, 1))
    body = []
    for name, n, x, y in cells:
        a, b = 150 + 210 * x, 80 + 170 * y
        body += [f'<rect x="{a}" y="{b}" width="200" height="160" fill="{INK[0]}" fill-opacity="{0.1 + 0.8 * n / total:.3f}"/>', f'<text x="{a + 100}" y="{b + 75}" text-anchor="middle" font-size="22">{n}</text>', f'<text x="{a + 100}" y="{b + 105}" text-anchor="middle" font-size="12">{escape(name)}</text>']
    return _svg("Confusion matrix", "Rows by label and prediction.", body)
