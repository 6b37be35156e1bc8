"""A corpus of ten invented pages that shows every status; dates count back from as_of."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from trustlake.schema import DOCUMENT

_SITE = "https://handbook.example.com/pages/"
_CHECKS = "Before the first parcel leaves, confirm the warehouse contact, carrier account, label printer, customs profile, pickup window, and return address."


def _body(as_of: datetime, prose: str, reviewed: int | None = None, deprecated: int | None = None, **fields: str) -> str:
    day = lambda n: (as_of - timedelta(days=n)).strftime("%Y-%m-%d")
    lines = [f"{name.replace('_', ' ')}: {value}" for name, value in fields.items()]
    lines += [f"Last reviewed: {day(reviewed)}"] if reviewed is not None else []
    lines += [f"Deprecated as of: {day(deprecated)}"] if deprecated is not None else []
    return "\n".join([*lines, "", prose, ""] if lines else [prose, ""])


def demo(spark: SparkSession, as_of: datetime) -> DataFrame:
    """The demonstration corpus as documents: 3 current, 3 stale, 3 to be reviewed, 1 unknown."""
    q = {"Review_cadence": "Quarterly"}
    new = "Parcel API Guide v3"
    link = (f"{_SITE}parcel-api-guide-v3", None, new, f"replaced by {new}", f"This page has been replaced by {new}.", "demo")
    pages = [
        ("Parcel Handling Guide", 5, _body(as_of, f"How parcels move through the network.\nSee Parcel Access Control.\nSee {new}.", 30, Status="Current", Owner="Parcel Platform", Canonical="true", Applies_to="Production parcels", **q), []),
        ("Parcel API Guide v1", 520, _body(as_of, "Parcel API v1 calls.\n\nA label is printed in the same call. Fields are weight, sender and receiver. Errors are plain text."), []),
        ("Parcel API Guide v2", 260, _body(as_of, "Parcel API v2 calls.\n\nLabels come from a queue that is asked every minute; each request carries a number against double printing. Errors have codes and hints."), []),
        (new, 3, _body(as_of, "Orders of labels are confirmed by events. Send the request number again after a failure.\nSee Parcel Access Control.", 20, Status="Current", Owner="Parcel API Team", Applies_to="Parcel API v3", **q), []),
        ("Former Parcel Gateway", 500, _body(as_of, "The gateway that the old desktop client used. New shops choose the parcel API.", 700, 400, Status="Legacy", Owner="Parcel Platform", Replaced_by=new), [link]),
        ("Parcel Access Control", 12, _body(as_of, "Register a client, ask for a short token and change its secret every month.\nSee Parcel Handling Guide.", 500, Status="Supported", Owner="Access Team", Applies_to="Client tokens", **q), []),
        ("Carrier Retry Rules", 8, _body(as_of, "Repeat a call only if the carrier did not answer, with growing pauses.\nSee Carrier Outage Runbook.", 45, Status="Current", Owner="Carrier Desk", **q), []),
        ("Shop Opening Checklist", 6, _body(as_of, f"{_CHECKS} Name the person who opens the shop and send one parcel as a trial.\nSee Parcel Handling Guide.", 25, Status="Current", Owner="Shop Desk", **q), []),
        ("Shop Start Checklist Draft", 120, _body(as_of, f"{_CHECKS} Name the person that opens the shop and send a parcel as a trial.\nSee Parcel Handling Guide.", 80, Status="Draft", Owner="Shop Desk"), []),
        ("Parcel Team Notes", 10, _body(as_of, "Thoughts from a workshop: fewer handovers, clearer owners, a board for open questions."), []),
    ]
    rows = []
    for n, (title, age, content, links) in enumerate(pages):
        slug = title.lower().replace(" ", "-")
        rows.append((n, slug, title, content, "demo", f"{_SITE}{slug}", as_of - timedelta(days=age), False, "{}", [], links))
    return spark.createDataFrame(rows, DOCUMENT)
