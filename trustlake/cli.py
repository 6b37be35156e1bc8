"""Command line: demo, scan of landed tables, history, findings, triage."""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from trustlake import reports, schema
from trustlake.config import Config
from trustlake.operators import findings as W
from trustlake.operators.history import scan_history
from trustlake.plans.audit import audit
from trustlake.plans.tables import written
from trustlake.sources import landed, scopes
from trustlake.sources.demo import demo
from trustlake.store import Heartbeat, Store


def _documents(spark: SparkSession, args: argparse.Namespace, config: Config):
    if args.command == "demo":
        return demo(spark, datetime.now(UTC))
    if (args.source or config.source_kind()) == "confluence":
        pages = landed.read(spark, args.pages, landed.WIKI_PAGE)
        pages = scopes.wiki(pages, args.query, args.root or config.page_id, args.space or config.space_key)
        return landed.numbered(landed.wiki_documents(pages, config.base_url))
    pages, blocks = landed.read(spark, args.pages, landed.WORKSPACE_PAGE), landed.read(spark, args.blocks, landed.BLOCK)
    pages = scopes.workspace(pages, blocks, args.query, args.database or config.database_id, args.root or config.root_page_id)
    return landed.numbered(landed.workspace_documents(pages, blocks))


def _report(results: DataFrame, args: argparse.Namespace) -> str:
    text = reports.write(results, args.format, args.output)
    return text if text is not None else args.output


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="trustlake")
    parser.add_argument("--store", help="folder of scans and findings; trustlake-store, or trustlake-demo for the demo, which empties it first")
    parser.add_argument("--config")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("demo", "scan"):
        c = commands.add_parser(name)
        c.add_argument("--format", choices=("table", "json"), default="table")
        c.add_argument("--output")
        c.add_argument("--full", action="store_true", help="look at unchanged pages too")
    c.add_argument("--no-db", action="store_true", help="report only: no scan, results or findings are stored")
    for option in ("--source", "--pages", "--blocks", "--space", "--root", "--database", "--query"):
        c.add_argument(option)
    commands.add_parser("history").add_argument("--limit", type=int, default=10)
    c = commands.add_parser("findings")
    c.add_argument("--state", action="append", choices=schema.WORKFLOW_STATES)
    c.add_argument("--scan", type=int)
    c.add_argument("--all", action="store_true")
    c = commands.add_parser("triage")
    c.add_argument("finding")
    c.add_argument("state", choices=schema.WORKFLOW_STATES)
    for option in ("--note", "--owner", "--due", "--until", "--reason"):
        c.add_argument(option)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config, now = Config.load(args.config), datetime.now(UTC)
    if getattr(args, "no_db", False):
        print(_report(written(audit(_documents(spark, args, config), config.settings(now)), "cli-results"), args))
        return 0
    store = Store(spark, args.store or ("trustlake-demo" if args.command == "demo" else "trustlake-store"))
    if args.command in ("demo", "scan"):
        if (args.command == "demo" and not store.clear(now)) or (token := store.try_start(now)) is None:
            print("A scan is running.")
            return 1
        with Heartbeat(store, token):
            scan, results, counts = store.run(_documents(spark, args, config), config.settings(now), token, "full" if args.full else "changed")
        print(_report(results, args))
        print(f"Scan {scan}: " + ", ".join(f"{n} {k.replace('_', ' ')}" for k, n in counts.items()))
    elif args.command == "history":
        scan_history(store.scans(), store.results(), args.limit).show(args.limit, truncate=False)
    elif args.command == "findings":
        for r in W.queue(store.findings(), now, args.scan, args.state, args.all).toLocalIterator():
            print(f"{r.finding_key}  {r.workflow_state:<13} {r.document_id}  {r.title}")
    else:
        given = {"state": args.state, "note": args.note, "assigned_owner": args.owner, "due_date": args.due, "snoozed_until": args.until, "dismissal_reason": args.reason}
        key = W.by_prefix(store.findings(), args.finding)
        store.update_finding(key, now, **{k: v for k, v in given.items() if v is not None})
        print(f"{key}: {args.state}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
