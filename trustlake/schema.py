"""Column layouts, enumerations and thresholds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINK = "struct<url:string,target_id:string,target_title:string,text:string,context:string,source:string>"

#: doc_ord is the fetch order; ties are decided by it.
DOCUMENT = (
    "doc_ord long, id string, title string, content string, source_type string, url string, last_modified timestamp, "
    f"archived boolean, metadata string, metadata_links array<string>, links array<{LINK}>"
)

#: Every key that a signal's details can have.
DETAILS = {
    "age_days": "int", "threshold": "int",
    "duplicate_of": "string", "duplicate_title": "string", "similarity": "double",
    "found_version": "string", "current_version": "string", "current_doc_id": "string", "current_doc_title": "string",
    "similar_to": "string", "similar_title": "string", "label": "string",
    "url": "string", "status_code": "int", "error": "string",
    "referenced_title": "string", "resolved_doc_id": "string", "resolved_title": "string", "normalized_reference": "string", "match_type": "string", "resolution_scope": "string",
    "matching_doc_ids": "array<string>", "matching_titles": "array<string>",
    "matching_class": "string", "matching_count": "int",  # instead of the lists where a class is large, see signals.matching_pages
    "target_id": "string", "target_title": "string", "link_text": "string",
}
DETAILS_TYPE = f"struct<{','.join(f'{k}:{t}' for k, t in DETAILS.items())}>"
SIGNAL_TYPE = f"struct<signal_type:string,severity:string,message:string,details:{DETAILS_TYPE}>"

SEVERITIES = ("info", "warning", "critical")
STATUSES = ("stale", "needs_review", "unknown", "current")
WORKFLOW_STATES = ("open", "acknowledged", "snoozed", "accepted_risk", "dismissed", "fixed")
TERMINAL_STATES = ("accepted_risk", "dismissed", "fixed")

AGE_WARNING_DAYS, AGE_CRITICAL_DAYS = 90, 180
SIMILARITY_THRESHOLD = 0.80
FRESH_DAYS, OLD_DAYS = 180, 365
IMPORTANCE_THRESHOLD = 2
# Most days between two reviews.
CADENCE_DAYS = {"weekly": 14, "monthly": 45, "quarterly": 120, "semi-annually": 210, "annually": 395, "yearly": 395}


def details(**given: Column) -> Column:
    """A details struct with the given keys; the others are null."""
    return F.struct(*[given.get(k, F.lit(None)).cast(t).alias(k) for k, t in DETAILS.items()])


def signal_columns(analyzer: int, order: Column, kind: str | Column, severity: str | Column, message: Column, found: Column) -> list[Column]:
    """The columns of a signal row beside doc_id."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return [F.lit(analyzer).alias("analyzer_ord"), order.cast("array<long>").alias("sig_ord"), lit(kind).alias("signal_type"), lit(severity).alias("severity"), message.alias("message"), found.alias("details")]
