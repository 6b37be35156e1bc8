"""Reports of a scan's results: a table for the console, JSON, and a review list. They show what is collected of
one scan, in the order of operators.history.ordered_results."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from trustlake.operators.history import ordered_results, report_counts

_LABELS = {"stale": "Stale", "needs_review": "Needs review", "unknown": "Unknown", "current": "Current"}


def console(results: DataFrame, width: int = 40) -> str:
    """A line for each page, by status, and the counts."""
    cut = lambda text: text if len(text) <= width else f"{text[: width - 1]}…"
    lines = [f"{'Status':<13} {'Conf.':>5}  {'Title':<{width}}  {'Source':<10}  {'Replacement':<20}  Reason"]
    for r in ordered_results(results).select("status", "confidence", "title", "source_type", "suggested_replacement_id", "confidence_reason").toLocalIterator():
        lines.append(f"{_LABELS[r.status]:<13} {r.confidence:>5.0%}  {cut(r.title):<{width}}  {r.source_type:<10}  {r.suggested_replacement_id or '-':<20}  {r.confidence_reason}")
    counts = report_counts(results).first().asDict()
    return "\n".join([*lines, "", ", ".join(f"{counts[k]} {v.lower()}" for k, v in _LABELS.items())])


def json_report(results: DataFrame) -> dict:
    """Counts and every page with its status, reasons, signals and metadata."""
    columns = ["document_id", "title", "source_type", "url", "status", "confidence", "confidence_reason", "suggested_replacement_id", "signals", "trust_metadata"]
    return {"summary": report_counts(results).first().asDict(), "documents": [json.loads(x) for x in ordered_results(results).select(*columns).toJSON().toLocalIterator()]}


def review_report(results: DataFrame) -> dict:
    """Counts, the pages of each status that needs a look, and those that need a person."""
    rows = [json.loads(x) for x in ordered_results(results).select("document_id", "title", "url", "status", "confidence", "confidence_reason", "trust_metadata", "trust_evidence").where("status <> 'current'").toJSON().toLocalIterator()]
    lists = {s: [r for r in rows if r["status"] == s] for s in ("stale", "needs_review", "unknown")}
    return {"summary": report_counts(results).first().asDict(), **lists, "human_audit": [r for r in rows if r["trust_metadata"]["requires_human_audit"]]}


def review_text(results: DataFrame) -> str:
    report = review_report(results)
    lines = [", ".join(f"{report['summary'][k]} {v.lower()}" for k, v in _LABELS.items())]
    for status in ("stale", "needs_review", "unknown"):
        for r in report[status]:
            lines += ["", f"[{_LABELS[status]}] {r['title']} ({r['confidence']:.0%})", f"  {r['trust_evidence']['summary']}", f"  Reason: {r['confidence_reason']}"]
            lines += [f"  {r['url']}"] if r.get("url") else []
    return "\n".join(lines)


def write(results: DataFrame, kind: str = "table", path: str | None = None) -> str | None:
    """The report as text, or into a file."""
    text = console(results) if kind == "table" else json.dumps(json_report(results), indent=2, ensure_ascii=False)
    if path is None:
        return text
    Path(path).write_text(text)
    return None
