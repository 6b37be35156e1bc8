"""Scans into a store, the lease, landed sources, reports, the command line and continuous scans."""

import json
import os
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trustlake import cli, config, reports
from trustlake.operators import findings as W
from trustlake.plans.audit import Settings
from trustlake.sources import landed
from trustlake.sources.demo import demo
from trustlake.store import Heartbeat, LeaseLost, Store
from trustlake.streaming.incremental import latest, watch

NOW = datetime(2026, 1, 15, 12, tzinfo=UTC)


def test_scans(spark, tmp_path):
    store, settings = Store(spark, str(tmp_path / "s")), Settings(NOW, near_duplicates=False)
    docs = demo(spark, NOW)
    one, results, counts = store.run(docs, settings)
    assert (one, results.count(), counts["new"]) == (1, 10, 6)
    two, results, counts = store.run(docs, settings)
    assert results.count() == 0 and counts == {"new": 0, "updated": 6, "reopened": 0, "auto_fixed": 0} and store.results(two).count() == 10
    changed = docs.withColumn("content", F.when(F.col("id") == "carrier-retry-rules", "Status: Current\nOwner: Ann B\n").otherwise(F.col("content")))
    three, results, counts = store.run(changed, settings)
    assert [r.document_id for r in results.collect()] == ["carrier-retry-rules"] and counts["auto_fixed"] == 1
    key = store.findings().where("workflow_state = 'open'").first().finding_key
    assert store.update_finding(key, NOW, state="dismissed") and not store.update_finding("none", NOW, state="open")
    assert store.prune(keep=1) == 2 and [r.scan_id for r in store.scans().collect()] == [3]
    with pytest.raises(Exception):
        store.run(docs.drop("content"), settings)
    assert {r.scan_id: r.status for r in store.scans().collect()} == {3: "completed", 4: "failed"}
    assert store.clear(NOW) and store.results() is None


def test_lease(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    now = datetime.now(UTC)
    token = store.try_start(now)
    assert token and store.try_start(now) is None and store.owns(token, now) and store.renew(token, now)
    assert not store.clear(now)
    later = now + timedelta(seconds=301)
    other = store.try_start(later)
    assert other and not store.owns(token, later) and not store.renew(token, later)
    with pytest.raises(LeaseLost):
        store.check(token)
    with Heartbeat(store, other, every=0.05):
        pass
    assert not store.scanning(later)


def folders(store):
    return {p.name.split("-")[0] + "-" for p in store.folder.iterdir() if p.is_dir()}, sum(p.is_dir() for p in store.folder.iterdir())


def test_a_lock_of_a_dead_process_is_taken_over(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    lock = store.folder / "store.lock"
    lock.touch()
    with pytest.raises(FileExistsError), store._locked(wait=0.1):
        pass
    old = datetime.now().timestamp() - 60
    os.utime(lock, (old, old))
    assert store.try_start(datetime.now(UTC)) and not lock.exists()


def test_triage_during_a_scan_is_kept(spark, tmp_path, monkeypatch):
    store, docs = Store(spark, str(tmp_path / "s")), demo(spark, NOW)
    store.run(docs, Settings(NOW, near_duplicates=False))
    key = store.findings().where("workflow_state = 'open'").first().finding_key
    whole, done = W.merge, []

    def merge(findings, *args):
        out = whole(findings, *args)
        if not done:  # while the scan merges what it read, someone acknowledges a finding
            done.append(store.update_finding(key, NOW, state="acknowledged"))
        return out

    monkeypatch.setattr("trustlake.store.W.merge", merge)
    store.run(docs, Settings(NOW, near_duplicates=False))
    found = {r.finding_key: r for r in store.findings().collect()}
    assert done == [True] and found[key].workflow_state == "acknowledged" and {r.last_seen_scan_id for r in found.values()} <= {1, 2}


def test_pruned_and_failed_scans_leave_no_data(spark, tmp_path):
    store, docs = Store(spark, str(tmp_path / "s")), demo(spark, NOW)
    for _ in range(2):
        store.run(docs, Settings(NOW, near_duplicates=False))
    assert store.sweep() == 0 and store.sweep(older=-1) == 1 and folders(store)[1] == 5  # two scans' results and what they looked at, and the findings
    assert store.prune(keep=1) == 1 and folders(store)[1] == 3
    with pytest.raises(Exception):
        store.run(docs.drop("content"), Settings(NOW))
    assert folders(store)[1] == 3
    store.fail(2, "token=abc")
    assert store.results() is None and {r.error for r in store.scans().where("scan_id = 2").collect()} == {"token=[REDACTED]"}


def test_a_scan_with_its_findings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    scan, _, _ = store.run(demo(spark, NOW), Settings(NOW, near_duplicates=False))
    keys = [r.finding_key for r in store.findings().orderBy("finding_key").collect()]
    later = NOW + timedelta(days=3)
    assert store.update_finding(keys[0], NOW, state="snoozed", snoozed_until=later) and store.update_finding(keys[1], NOW, state="dismissed", note="known")
    found = store.findings()
    rows = {r.workflow.finding_key if r.workflow else r.document_id: r for r in W.results_with_workflow(store.results(), found, NOW, scan).collect()}
    assert len(rows) == 10 and sum(r.workflow is not None for r in rows.values()) == len(keys) == 6
    assert (rows[keys[0]].workflow.is_actionable, rows[keys[1]].workflow.is_actionable, rows[keys[2]].workflow.is_actionable) == (False, False, True)
    assert rows[keys[1]].workflow.note == "known" and rows[keys[2]].workflow.assigned_owner == ""
    assert all(r.workflow is None for r in W.results_with_workflow(store.results(), found.withColumn("last_checked_scan_id", F.lit(9)), NOW, scan).collect())
    counts = lambda *a: {r.workflow_state: r.n for r in W.state_counts(found, *a).collect()}
    assert counts() == counts(NOW, scan, True) == {"open": 4, "snoozed": 1, "dismissed": 1} and counts(NOW, scan + 1, True) == {}
    assert counts(NOW, scan, False) == {"open": 4} and counts(later, scan, False) == {"open": 4, "snoozed": 1}
    one = store.finding(keys[0]).collect()
    assert [(r.workflow_state, r.status in ("stale", "needs_review")) for r in one] == [("snoozed", True)] and store.finding("none").count() == 0


def test_wiki_pages(spark, tmp_path):
    page = {"id": "7", "status": "current", "title": "T", "body": {"storage": {"value": "<p>Replaced by <a href='/wiki/x'>X</a></p>"}}, "version": {"number": 2, "when": "2026-01-02T03:04:05.000Z"}, "ancestors": [{"id": "1", "title": "Root", "space": {"key": "ENG"}}], "_links": {"webui": "/p/7"}}
    (tmp_path / "pages.json").write_text("\n".join(map(json.dumps, [page, page | {"id": "8", "body": {"storage": {"value": "<p> </p>"}}}, page | {"id": "9", "ancestors": []}])))
    pages = landed.read(spark, str(tmp_path / "pages.json"), landed.WIKI_PAGE)
    docs = {r.id: r for r in landed.wiki_documents(pages, "https://w.example").collect()}
    assert set(docs) == {"confluence-7", "confluence-9"}
    d = docs["confluence-7"]
    assert (d.content, d.url, d.last_modified.isoformat()[:19], d.links[0].url, d.links[0].context) == ("Replaced by X", "https://w.example/p/7", "2026-01-02T03:04:05", "https://w.example/wiki/x", "Replaced by X")
    assert json.loads(d.metadata)["space_key"] == "ENG"
    assert sorted(r.id for r in landed.in_tree(pages, "1").collect()) == ["7", "8"] and landed.in_space(pages, "ENG").count() == 2


def test_workspace_pages(spark, tmp_path):
    rich = lambda text, href=None: [{"plain_text": text, "href": href}]
    pages = [
        {"id": "p", "url": "u", "last_edited_time": "2026-01-02T00:00:00Z", "properties": {"Name": {"type": "title", "title": [{"plain_text": "Guide v1"}]}}, "parent": {"type": "database_id", "database_id": "db"}},
        {"id": "q", "properties": {}, "child_page": {"title": "guide V2"}, "parent": {"type": "page_id", "page_id": "p"}}, {"id": "r", "properties": {}, "parent": {"type": "page_id", "page_id": "q"}},
    ]
    blocks = [
        {"id": "b1", "parent_id": "p", "position": 1, "type": "paragraph", "has_children": True, "data": {"rich_text": rich("one", "https://x.example")}},
        {"id": "b2", "parent_id": "p", "position": 2, "type": "table_row", "data": {"cells": [rich("a"), rich("b")]}}, {"id": "b3", "parent_id": "b1", "position": 0, "type": "toggle", "data": {"rich_text": rich("inner")}},
        {"id": "b4", "parent_id": "p", "position": 3, "type": "bookmark", "data": {"url": "https://y.example", "caption": rich("cap")}}, {"id": "q", "parent_id": "p", "position": 4, "type": "child_page", "data": {}},
    ]
    for name, rows in (("p", pages), ("b", blocks)):
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
    p, b = landed.read(spark, str(tmp_path / "p.json"), landed.WORKSPACE_PAGE), landed.read(spark, str(tmp_path / "b.json"), landed.BLOCK)
    docs = landed.workspace_documents(p, b).collect()
    assert [(d.id, d.title, d.content, [x.url for x in d.links]) for d in docs] == [("p", "Guide v1", "one\ninner\na | b", ["https://x.example", "https://y.example"])]
    assert sorted(r.id for r in landed.below(p, "db").collect()) == ["p", "q", "r"] and [r.id for r in landed.in_database(p, "db").collect()] == ["p"]
    assert sorted(r.id for r in landed.same_title(p, "p").collect()) == ["p", "q"] and [r.id for r in landed.same_title(p, "r").collect()] == ["r"]
    assert landed.only_page(p, "GUIDE V1") == "p" and landed.titled(p, "guide").count() == 2
    with pytest.raises(ValueError):
        landed.only_page(p, "none")
    urls = spark.createDataFrame([("https://www.notion.so/T-0123456789abcdef0123456789ABCDEF?v=1",), ("https://x.example/",)], "u string")
    assert [r[0] for r in urls.select(landed.page_id_of(F.col("u"))).collect()] == ["01234567-89ab-cdef-0123-456789ABCDEF", None]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("confluence: {base_url: 'https://w.example/', space_key: ENG}\nanalyzers: {timestamp: {warning_days: 5}, version_refs: {current_versions: {API: v2}}}\n")
    pytest.importorskip("yaml")
    c = config.Config.load(str(tmp_path / "c.yaml"), {"CONFLUENCE_API_TOKEN": "t"})
    assert (c.base_url, c.source_kind(), c.warning_days, c.current_versions) == ("https://w.example", "confluence", 5, {"API": "v2"})
    assert config.Config.load(None, {}).source_kind() == "notion"
    assert config.tree_target("confluence", " 12 ") == ("id", "12") and config.tree_target("notion", "My Page") == ("title", "My Page")
    assert config.tree_target("notion", "https://www.notion.so/T-0123456789abcdef0123456789abcdef")[1] == "01234567-89ab-cdef-0123-456789abcdef"
    for kind, bad in (("confluence", "x"), ("notion", ""), ("notion", "https://x.example/")):
        with pytest.raises(ValueError):
            config.tree_target(kind, bad)


def test_command_line_and_reports(spark, tmp_path, capsys):
    folder = str(tmp_path / "s")
    assert cli.main(["--store", folder, "demo"]) == 0
    out = capsys.readouterr().out
    assert "3 stale, 3 needs review, 1 unknown, 3 current" in out and "6 new" in out
    results = Store(spark, folder).results()
    report = reports.json_report(results)
    assert report["summary"]["total"] == len(report["documents"]) == 10 and len(reports.review_report(results)["human_audit"]) == 6
    assert "[Stale] Parcel API Guide v1" in reports.review_text(results)
    reports.write(results, "json", str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["summary"]["stale"] == 3
    key = Store(spark, folder).findings().first().finding_key
    assert cli.main(["--store", folder, "triage", key[:10], "dismissed", "--reason", "known"]) == 0
    assert cli.main(["--store", folder, "findings"]) == 0 and cli.main(["--store", folder, "history"]) == 0


def test_continuous_scans(spark, tmp_path):
    docs = demo(spark, NOW)
    docs.union(docs.withColumn("doc_ord", F.col("doc_ord") + 100)).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "s"))
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), store, Settings(NOW, near_duplicates=False), str(tmp_path / "c")).awaitTermination()
    assert store.scans().count() == 1 and store.results().count() == 10 and latest(docs.union(docs)).count() == 10


def test_a_demo_starts_from_an_empty_store_and_a_scan_can_leave_none(spark, tmp_path, capsys, monkeypatch):
    folder = str(tmp_path / "s")
    for _ in range(2):
        assert cli.main(["--store", folder, "demo"]) == 0
        assert "Scan 1: 6 new" in capsys.readouterr().out
    assert Store(spark, folder).scans().count() == 1
    assert Store(spark, folder).try_start(datetime.now(UTC))
    assert cli.main(["--store", folder, "demo"]) == 1
    monkeypatch.chdir(tmp_path)
    page = {"id": "7", "title": "T", "body": {"storage": {"value": "<p>text</p>"}}, "space": {"key": "ENG"}}
    (tmp_path / "pages.json").write_text(json.dumps(page))
    assert cli.main(["scan", "--no-db", "--source", "confluence", "--pages", str(tmp_path / "pages.json"), "--space", "ENG"]) == 0
    assert "1 unknown" in capsys.readouterr().out and not (tmp_path / "trustlake-store").exists()
    with pytest.raises(ValueError, match="needs"):
        cli.main(["scan", "--no-db", "--source", "confluence", "--pages", str(tmp_path / "pages.json")])


def test_a_scan_counts_while_it_writes(spark, tmp_path):
    """No job of its own counts the results or the changes of findings."""
    store, jobs = Store(spark, str(tmp_path / "s")), []
    tracker = spark.sparkContext.statusTracker()
    for label, mode in (("first", "full"), ("again", "full")):
        spark.sparkContext.setJobGroup(label, label)
        _, results, counts = store.run(demo(spark, NOW), Settings(NOW, near_duplicates=False), mode=mode)
        jobs.append(len(tracker.getJobIdsForGroup(label)))
        assert results.count() == 10
        assert store.scans().orderBy(F.desc("scan_id")).first().document_count == 10
    spark.sparkContext.setJobGroup("rest", "rest")
    assert counts == {"new": 0, "updated": 6, "reopened": 0, "auto_fixed": 0}
