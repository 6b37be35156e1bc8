"""Registered queries against DuckDB on the smallest tables, and the driver's entry points."""

import ast
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from trustlake import queries as core

ROOT = Path(__file__).parent.parent
SLOW = {"near_duplicates", "audit_pipeline"}


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_matches_sql(spark, sf, sql, name):
    df = entry.queries()[name](spark, sf)
    expected = sql.sql(core.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    assert got == ordered(sql.sql(f"select {', '.join(columns)} from ({core.ORACLES[name]}) q").fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES) - SLOW))
def test_runs(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_counts_are_those_of_the_audit(spark, sf):
    verdicts = entry.queries()["audit_pipeline"](spark, sf)
    counts = entry.queries()["status_counts"](spark, sf).first()
    assert {r.status: r["count"] for r in verdicts.groupBy("status").count().collect()} == {k: v for k, v in counts.asDict().items() if k != "total" and v}
    docs = core.S.prepare(core.kb(spark, sf))
    near = core._results(spark, sf).where("exists(signals, s -> s.signal_type = 'near_duplicate')")
    assert {r.document_id for r in near.collect()} == {r.doc_id for r in core.S.near_duplicates(docs).collect()} != set()


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_nothing_else_imports_the_llm_folder():
    for path in (ROOT / "trustlake").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and os.path.isdir(ROOT / "tests")


def test_the_audit_runs_all_operators(spark, sf):
    rows = core.audit_pipeline(spark, sf).collect()
    kinds = {part.rsplit(" ", 1)[0] for r in rows for part in r.signals.split(", ") if part}
    assert {"age", "version_ref", "broken_link", "version_marker", "resolved_reference", "unresolved_reference", "ambiguous_reference", "replacement_link", "near_duplicate"} <= kinds, kinds


def test_search_scopes_send_no_table_through_the_driver(spark, sf):
    plan = core.search_scopes(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
