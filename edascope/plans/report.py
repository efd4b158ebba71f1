"""A self-contained HTML page of a report: no script, every value escaped, charts as inline SVG."""

from __future__ import annotations

from html import escape
from pathlib import Path
from string import Template
from typing import Any

from edascope.operators.correlation import CorrelationAnalyzer
from edascope.types import EDAReport

PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>$title</title>
<style>
body{font:15px/1.5 system-ui,sans-serif;max-width:1000px;margin:2em auto;padding:0 1em;color:#222}
table{border-collapse:collapse;margin:.6em 0}td,th{border:1px solid #ccc;padding:.25em .6em;text-align:left}
section{margin:2em 0}.grade{font-size:2.4em}.warn{background:#fff3cd;padding:.5em 1em}svg{max-width:100%}
</style></head><body><h1>$title</h1><p>$made</p>
$sections
</body></html>
"""


def _table(head: list[str], rows: list[list[Any]]) -> str:
    cell = lambda tag, v: f"<{tag}>{escape('' if v is None else f'{v:,.4g}' if isinstance(v, float) else str(v))}</{tag}>"
    return "<table><tr>" + "".join(cell("th", h) for h in head) + "</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows) + "</table>"


def _list(items: list[str]) -> str:
    return "<ul>" + "".join(f"<li>{escape(x)}</li>" for x in items) + "</ul>" if items else ""


def _bars(values: dict[str, float], colour: Any) -> str:
    top = max(values.values(), default=0) or 1
    rows = "".join(f'<text x="0" y="{22 * i + 15}" font-size="12">{escape(k[:24])}</text><rect x="180" y="{22 * i + 3}" width="{500 * v / top:.1f}" height="16" fill="{colour(v)}"/><text x="{186 + 500 * v / top:.1f}" y="{22 * i + 15}" font-size="12">{v:,.4g}</text>' for i, (k, v) in enumerate(values.items()))
    return f'<svg viewBox="0 0 760 {22 * len(values) + 6}" role="img">{rows}</svg>'


class HTMLReportGenerator:
    """template_path names a string.Template with $title, $made and $sections; without it, or if there is no such file, the own page is used."""

    def __init__(self, template_path: str | None = None) -> None:
        own = template_path and Path(template_path).is_file()
        self.template = Template(Path(template_path).read_text(encoding="utf-8") if own else PAGE)

    def charts(self, report: EDAReport) -> dict[str, dict[str, Any]]:
        """The report's charts as plain data and layout, for callers that draw them on their own."""
        out: dict[str, dict[str, Any]] = {}
        missing, outliers, matrix = report.missing_values, report.outliers, report.correlations.correlation_matrix if report.correlations else {}
        if missing and missing.column_missing:
            share = {c: 100 * e["null_ratio"] for c, e in missing.column_missing.items()}
            out["missing"] = {"type": "bar", "x": list(share), "y": list(share.values()), "colors": [self._severity(v) for v in share.values()]}
        if outliers and outliers.outliers_by_column:
            out["outliers"] = {"type": "bar", "x": list(outliers.outliers_by_column), "y": [e["outlier_count"] for e in outliers.outliers_by_column.values()]}
        if matrix:
            out["correlations"] = {"type": "heatmap", "zmin": -1, "zmax": 1, "colorscale": "RdBu", **CorrelationAnalyzer().get_correlation_heatmap_data(matrix)}
        return out

    @staticmethod
    def _severity(percent: float) -> str:
        return "#c0392b" if percent > 50 else "#d68910" if percent > 20 else "#2874a6"

    def _heatmap(self, chart: dict[str, Any]) -> str:
        n, size = len(chart["x"]), 46
        shade = lambda v: f"rgb({int(255 * min(1, 1 + v))},{int(255 * (1 - abs(v)))},{int(255 * min(1, 1 - v))})"
        cells = "".join(f'<rect x="{130 + size * j}" y="{size * i}" width="{size}" height="{size}" fill="{shade(v)}"/><text x="{130 + size * j + 8}" y="{size * i + 27}" font-size="12">{v:.2f}</text>' for i, row in enumerate(chart["z"]) for j, v in enumerate(row))
        names = "".join(f'<text x="0" y="{size * i + 27}" font-size="12">{escape(x[:18])}</text><text x="{134 + size * i}" y="{size * n + 16}" font-size="10">{escape(x[:8])}</text>' for i, x in enumerate(chart["x"]))
        return f'<svg viewBox="0 0 {140 + size * n} {size * n + 24}" role="img">{cells}{names}</svg>'

    def sections(self, report: EDAReport) -> list[tuple[str, str]]:
        out, charts = [], self.charts(report)
        if q := report.quality_score:
            out.append(("Quality", f'<p class="grade">{escape(q.grade)} {q.overall:.1f}</p><p>{escape(q.summary)}</p>' + _table(["dimension", "score"], [[k, getattr(q, k)] for k in ("completeness", "uniqueness", "validity", "consistency")]) + _list(q.improvement_areas) + _list(q.strengths)))
        if s := report.schema:
            out.append(("Overview", f"<p>{s.row_count:,} rows, {s.column_count} columns, {escape(s.memory_usage_human)}, {s.duplicate_rows:,} repeated rows</p>" + _table(["column", "type", "meaning", "unique", "missing", "cardinality"], [[c, i.inferred_type.value, i.semantic_type, i.unique_count, i.null_count, i.cardinality] for c, i in s.columns.items()])))
        if m := report.missing_values:
            bars = _bars(dict(zip(charts["missing"]["x"], charts["missing"]["y"], strict=True)), self._severity) if "missing" in charts else ""
            out.append(("Missing values", f"<p>{m.total_missing:,} of {m.total_cells:,} cells</p>" + bars + _table(["column", "missing", "severity", "strategy"], [[c, e["null_count"], e["severity"], e["suggested_strategy"]] for c, e in m.column_missing.items()]) + _table(["missing together", "rows", "%"], [[", ".join(p["missing_columns"]), p["row_count"], p["percentage"]] for p in m.missing_patterns]) + _list(m.recommendations)))
        if d := report.duplicates:
            out.append(("Duplicates", _table(["exact", "near", "ratio"], [[d.exact_duplicates, d.fuzzy_duplicates, d.duplicate_ratio]]) + _list(d.recommendations)))
        if o := report.outliers:
            bars = _bars(dict(zip(charts["outliers"]["x"], charts["outliers"]["y"], strict=True)), lambda v: "#7d3c98") if "outliers" in charts else ""
            shown = lambda b: ", ".join(f"{k} {v:,.4g}" if isinstance(v, (int, float)) else f"{k} {v}" for k, v in b.items())
            out.append(("Outliers", f"<p>Method: {escape(o.method_used)}</p>" + bars + _table(["column", "outliers", "extreme", "bounds"], [[c, e["outlier_count"], e["extreme_count"], shown(e["bounds"])] for c, e in o.outliers_by_column.items()]) + _list(o.recommendations)))
        if c := report.correlations:
            heat = self._heatmap(charts["correlations"]) if "correlations" in charts else ""
            out.append(("Correlations", heat + _table(["column", "column", "correlation"], [[p["column_1"], p["column_2"], p["correlation"]] for p in c.high_correlations]) + _list(c.recommendations)))
        if report.warnings:
            out.append(("Warnings", '<div class="warn">' + _list(report.warnings) + "</div>"))
        return out

    def generate(self, report: EDAReport) -> str:
        body = "".join(f"<section><h2>{escape(t)}</h2>{b}</section>" for t, b in self.sections(report))
        made = f"Made {report.generated_at:%Y-%m-%d %H:%M} in {report.execution_time:.1f} s, version {report.version}"
        return self.template.safe_substitute(title=escape(report.dataset_name), made=escape(made), sections=body)

    def save(self, report: EDAReport, path: str) -> str:
        to = Path(path)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(self.generate(report), encoding="utf-8")
        return str(to)
