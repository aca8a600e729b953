"""HTML reports over aggregated frames: tables, and histograms or curves as inline SVG.

Only aggregates reach the driver: a report's frames have as many rows as a histogram has bins.
"""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame

_PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>
body{{font-family:sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:2px 8px;text-align:right}}svg{{border:1px solid #ddd}}</style></head>
<body><h1>{title}</h1>{body}<script type="application/json" id="data">{data}</script></body></html>"""


def table(df: DataFrame) -> str:
    rows = df.collect()
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def bars(counts: dict[int, int], width: int = 600, height: int = 160) -> str:
    """SVG bars of bin -> count."""
    if not counts:
        return "<svg/>"
    low, high, most = min(counts), max(counts), max(counts.values())
    step = width / (high - low + 1)
    each = "".join(f'<rect x="{(b - low) * step:.1f}" y="{height - height * n / most:.1f}" width="{step:.1f}" height="{height * n / most:.1f}" fill="#468"/>' for b, n in sorted(counts.items()))
    return f'<svg width="{width}" height="{height}">{each}</svg>'


def line(points: list[tuple[float, float]], size: int = 320) -> str:
    """SVG curve within the unit square."""
    path = " ".join(f"{x * size:.1f},{size - y * size:.1f}" for x, y in points)
    return f'<svg width="{size}" height="{size}"><polyline fill="none" stroke="#468" points="{path}"/></svg>'


def page(title: str, parts: list[tuple[str, str]], data: object = None) -> str:
    body = "".join(f"<h2>{escape(h)}</h2>{html}" for h, html in parts)
    return _PAGE.format(title=escape(title), body=body, data=json.dumps(data).replace("</", "<\\/"))


def alignment_report(title: str, counters: DataFrame, summary: DataFrame, histogram: DataFrame) -> str:
    """Counters and metric statistics per mate, with a histogram of each metric."""
    groups: dict[tuple, dict[int, int]] = {}
    for r in histogram.collect():
        groups.setdefault((r["metric"], r["mate"] or 0), {})[r["bin"]] = r["n"]
    parts = [("Reads", table(counters)), ("Metrics", table(summary))] + [(f"{m}, mate {k}", bars(c)) for (m, k), c in sorted(groups.items())]
    return page(title, parts, [[m, k, sorted(c.items())] for (m, k), c in sorted(groups.items())])


def threshold_slider(metric: str, rows: list[tuple[float, int, int]]) -> str:
    """A slider over thresholds that shows true and false positives at and above each."""
    data = escape(json.dumps(rows))
    show = "const r=JSON.parse(this.dataset.rows)[this.value];this.nextElementSibling.textContent=`at least ${r[0].toFixed(2)}: true ${r[1]}, false ${r[2]}`"
    return f'<p><input type="range" min="0" max="{max(len(rows) - 1, 0)}" value="0" data-rows="{data}" oninput="{escape(show)}"><span>{escape(metric)}</span></p>'


def evaluation_report(title: str, document: dict, parts: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> str:
    """Totals, and for each measure confusion counts, a threshold slider and curves with their areas."""
    totals = "".join(f"<tr><td>{escape(k)}</td><td>{v}</td></tr>" for k, v in document.items() if isinstance(v, int))
    out = [("Totals", f"<table>{totals}</table>")]
    for metric, (confusion, points, areas) in parts.items():
        rows = sorted(points.collect(), key=lambda r: r["step"])
        own = {k: [(r["x"], r["y"]) for r in rows if r["kind"] == k] for k in ("roc", "pr")}
        pools = [document[k][metric] for k in ("true_positives", "false_positives_control", "false_positives_cross")]
        above = [[sum(p["counts"][i:]) for i in range(max(len(p["counts"]) for p in pools))] for p in pools]
        steps = [(pools[0]["min_val"] + i * pools[0]["bin_width"], above[0][i], above[1][i] + above[2][i]) for i in range(len(above[0]))]
        out.append((metric, table(confusion) + threshold_slider(metric, steps) + table(areas) + line(own["roc"]) + line(own["pr"])))
    return page(title, out, document)


def comparison_report(title: str, runs: list[dict]) -> str:
    """Curves and areas of several runs, as compared documents hold them, for each measure."""
    parts = []
    for metric in dict.fromkeys(m for r in runs for m in r["curves"]):
        for r in runs:
            if c := r["curves"].get(metric):
                head = f"<p>ROC area {c['roc_auc']:.6f}, precision-recall area {c['pr_auc']:.6f}</p>"
                parts.append((f"{metric}: {r['id']}", head + line(list(zip(c["fpr"], c["tpr"], strict=True))) + line(list(zip(c["tpr"], c["precision"], strict=True)))))
    return page(title, parts, runs)
