"""Signals, verdicts and corrections on small corpora."""

from datetime import UTC, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trustlake.operators import signals as S
from trustlake.operators.history import reference_summary
from trustlake.plans.audit import Settings, audit
from trustlake.schema import DOCUMENT
from trustlake.sources.demo import demo

NOW = datetime(2026, 1, 15, 12, tzinfo=UTC)


def pages(spark, *given):
    rows = []
    for n, p in enumerate(given):
        age = p.get("age", 1)
        links = [(x.get("url"), x.get("target_id"), x.get("target_title"), x.get("text"), x.get("context"), "t") for x in p.get("links", [])]
        rows.append((n, p.get("id", f"d{n}"), p.get("title", f"Page {chr(97 + n)}"), p.get("content", f"text {n}"), "test", p.get("url"), None if age is None else NOW - timedelta(days=age), p.get("archived", False), "{}", [], links))
    return spark.createDataFrame(rows, DOCUMENT)


def results(spark, *given, **settings):
    return {r.document_id: r for r in audit(pages(spark, *given), Settings(NOW, **settings)).collect()}


def test_demo(spark):
    got = {r.document_id: r for r in audit(demo(spark, NOW), Settings(NOW)).collect()}
    states = {k: r.status for k, r in got.items()}
    assert states == {
        "parcel-handling-guide": "current", "parcel-api-guide-v1": "stale", "parcel-api-guide-v2": "stale", "parcel-api-guide-v3": "current", "former-parcel-gateway": "stale", "parcel-access-control": "needs_review",
        "carrier-retry-rules": "needs_review", "shop-opening-checklist": "current", "shop-start-checklist-draft": "needs_review", "parcel-team-notes": "unknown",
    }
    assert sum(r.trust_metadata.requires_human_audit for r in got.values()) == 6
    assert {k: r.suggested_replacement_id for k, r in got.items() if r.suggested_replacement_id} == {"parcel-api-guide-v1": "parcel-api-guide-v3", "parcel-api-guide-v2": "parcel-api-guide-v3", "shop-start-checklist-draft": "shop-opening-checklist"}
    assert got["parcel-api-guide-v3"].confidence == 1.0


def test_age(spark):
    docs = pages(spark, {"age": 89}, {"age": 90}, {"age": 180}, {"age": None})
    got = {r.doc_id: (r.severity, r.details.age_days) for r in S.age(docs, NOW).collect()}
    assert got == {"d1": ("warning", 90), "d2": ("critical", 180), "d3": ("warning", None)}


def test_duplicates_and_versions(spark):
    docs = S.prepare(pages(spark, {"content": "same", "age": 9, "title": "Guide v1"}, {"content": "same", "age": 3, "title": "Guide v3"}, {"content": "same", "age": None}, {"title": "Guide v2"}, {"title": "Other v1"}))
    exact = S.duplicates(docs)
    assert {r.doc_id: r.details.duplicate_of for r in exact.collect()} == {"d0": "d1", "d2": "d1"}
    assert {r.doc_id: (r.details.found_version, r.details.current_version) for r in S.version_markers(docs, exact).collect()} == {"d3": ("v2", "v3")}


def test_version_refs(spark):
    docs = pages(spark, {"content": "Use API v1 here."}, {"content": "migrating from API v1 to API v2"}, {"content": "migrating from v1"}, {"content": "API" + " x" * 60 + " v1"})
    got = [(r.doc_id, r.details.found_version) for r in S.version_refs(docs, {"API": "v2"}, (r"v\d+(?:\.\d+)*",)).orderBy("doc_id").collect()]
    assert got == [("d0", "v1")]


def test_references(spark):
    docs = S.prepare(pages(spark, {"title": "Setup Guide v1"}, {"title": "Setup Guide v2"}, {"title": "Runbook", "content": "See Setup Guide v2\nSee Setup Guide\nSee Runbook\nSee Nothing"}))
    got = [(r.signal_type, r.details.resolved_doc_id, r.details.matching_doc_ids) for r in S.references(docs).orderBy("sig_ord").collect()]
    assert got == [("resolved_reference", "d1", None), ("ambiguous_reference", None, ["d0", "d1"]), ("unresolved_reference", None, None), ("unresolved_reference", None, None)]


def test_internal_links(spark):
    links = [{"target_id": "d0", "text": "moved to Page"}, {"url": "https://k.example/p/"}, {"target_title": "page B", "context": "migrating from the"}, {"url": "https://k.example/none"}, {"url": "https://else.example/"}, {"target_title": "Nowhere"}, {"target_id": "d2", "target_title": "PAGE A"}]
    docs = S.prepare(pages(spark, {}, {"url": "https://k.example/p"}, {"url": "https://k.example/self", "links": links}))
    got = {r.sig_ord[0]: (r.signal_type, r.details.target_id) for r in S.internal_links(docs).collect()}
    assert got == {0: ("replacement_link", "d0"), 1: ("resolved_internal_link", "d1"), 2: ("backlink_from_successor", "d1"), 3: ("broken_internal_link", None), 5: ("broken_internal_link", None), 6: ("resolved_internal_link", "d0")}


def test_siblings_and_scope(spark):
    docs = S.prepare(pages(spark, {"title": "Guide v1"}, {"title": "Guide v2"}, {"title": "Guide (old)"}, {"title": "Plan One 2021", "content": "Region: eu\n"}, {"title": "Plan One 2024", "content": "Region: us\n"}, {"title": "Plan One 2023"}, {"title": "Alone (old)"}))
    got = {r.doc_id: r.reason for r in S.superseded(docs).collect()}
    assert got == {
        "d0": "Superseded by a related page in this scan: 'Guide v2' (version v2 > v1)", "d2": "Title has stale suffix '(old)' and a newer page 'Guide v1' exists in this scan",
        "d3": "Superseded by a related page in this scan: 'Plan One 2023' (year 2023 > 2021)", "d5": "Superseded by a related page in this scan: 'Plan One 2024' (year 2024 > 2023)",
    }


def test_near_duplicates_link_every_copy(spark):
    base = " ".join(f"word{i}" for i in range(120))
    docs = pages(spark, *[{"content": f"{base} end{n}", "age": n + 1} for n in range(9)], {"content": f"{base} end0", "age": 50}, {"content": "something else entirely here"})
    got = {r.doc_id: r.details.similar_to for r in S.near_duplicates(S.prepare(docs)).collect()}
    assert got == {f"d{n}": "d0" for n in range(1, 9)}


def test_near_duplicates_match_brute_force(spark):
    import random

    from trustlake.functions.similarity import similarity

    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    chain = [words[:]]
    for k in range(5):  # each edit is near the last one, the ends are not near each other
        chain.append([f"{'qxzvj'[k] * 6}{i}" if k * 11 <= i < k * 11 + 9 else w for i, w in enumerate(chain[-1])])
    solid = "".join(rng.choice("\u65e5\u672c\u8a9e\u6587\u5b57\u6c34\u706b") for _ in range(80))
    texts = [*map(" ".join, chain), solid, solid[:40] + "x" + solid[41:], solid[:-3], "", "  ", "a", *[" ".join(rng.choices(words, k=n)) for n in (5, 30, 300, 300)]]
    texts += [texts[-1] + " tail", texts[-2].replace("word1", "Word1"), " ".join(w + "s" for w in words)]
    given = [{"content": t, "age": rng.choice([None, 1, 2, 3])} for t in texts]
    docs = S.prepare(pages(spark, *given))
    rank = lambda n: (-given[n]["age"] if given[n]["age"] is not None else -(10**6), -n)
    expected = set()
    for a in range(len(texts)):
        for b in range(a):
            if (score := similarity(texts[a], texts[b])) >= 80:
                old, new = sorted((a, b), key=rank)
                expected.add((f"d{old}", f"d{new}", round(score, 1)))
    rows = S.near_duplicates(docs).collect()
    got = {(r.doc_id, r.details.similar_to, r.details.similarity) for r in rows}
    assert got == expected and len(rows) == len(got) > 10


def test_blocks_meet_without_being_written_for_each_other(spark):
    docs = pages(spark, *[{"content": " ".join(f"word{i * n % 97}" for i in range(20 + n % 50))} for n in range(600)])
    classes = docs.selectExpr("id", "0L t", "doc_ord o", "content").select("id", "t", "o", S.profiled("content").alias("p"))
    blocks, n = S._blocks(classes.dropDuplicates(["id"]))
    found = blocks.count()
    assert n == 600 and sorted(i for r in blocks.collect() for i in r.id) == sorted(f"d{k}" for k in range(600)) and found >= 600 / S.BLOCK
    both = S._block_pairs(blocks, n)
    met = [frozenset((r["at"], r["other_at"])) for r in both.select("at", "other_at").collect()]
    assert len(met) == len(set(met)) == found * (found + 1) // 2
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "Broadcast" not in plan


def test_bounds_by_groups_of_characters_lose_no_pair():
    import random

    import numpy as np

    from trustlake.functions import similarity as M

    rng = random.Random(3)
    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", range(26, 0, -1), k=rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.choice([40, 150, 400]))) for _ in range(24)] + ["", "a", "\u65e5\u672c" * 40]
    for t in texts[:24]:
        said = t.split()
        texts.append(" ".join(w if rng.random() < 0.8 else rng.choice(words) for w in said))
    blocks = [{"at": k, "id": [str(x) for x in own], "t": own, "o": own, "parts": [M.compared_parts(texts[x]) for x in own]} for k, own in enumerate((range(26), range(26, len(texts))))]
    left, right = map(M.Side, blocks)
    near = {(a, b) for a in range(26) for b in range(26, len(texts)) if M.similarity(texts[a], texts[b]) >= 80}
    i, j, _ = M._candidates(left, right, False, 80.0)
    kept = {(a, b + 26) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    alone = sum(np.minimum(left.bags[a], right.bags[b - 26]).sum() >= 0.8 * (left.lengths[a] + right.lengths[b - 26]).sum() / 2 for a in range(26) for b in range(26, len(texts)))
    assert near <= kept and len(near) > 15 and len(kept) < alone / 2
    rows = M._scored(left, right, False, 80.0)
    assert {(int(min(r[0], r[3], key=int)), int(max(r[0], r[3], key=int))) for r in rows} == near


def test_grids_bound_what_is_in_common():
    import numpy as np

    from trustlake.functions import similarity as M

    rng = np.random.default_rng(4)
    for kinds in (1, 2, 5, 12):
        left, right = ([rng.integers(0, kinds, n).astype(np.uint8) for n in rng.choice([0, 1, 62, 63, 64, 126, 190, 240, 260], 20)] for _ in range(2))
        right[3:6] = [np.concatenate([x[40:], x[:40]]) for x in left[3:6]]  # matches that are shifted far
        i, j = (x.ravel() for x in np.indices((20, 20)))
        exact, got = M._lengths(left, right, kinds, i, j).reshape(20, 20).T, M._grid(left, right, kinds)
        assert (got >= exact).all()
    alike = [np.concatenate([x, x])[:240] for x in (rng.integers(0, 12, 240).astype(np.uint8) for _ in range(20))]
    for k, x in enumerate(alike):
        x[rng.integers(0, 240, 10 * k)] = 0
    i, j = (x.ravel() for x in np.indices((20, 20)))
    exact, got = M._lengths(alike, alike, 12, i, j).reshape(20, 20).T, M._grid(alike, alike, 12)
    assert (got == np.maximum(exact, 240 - int(M._BAND * 240) - 2)).all() and (np.diag(got) == 240).all()


def _mixed_blocks(rng, number, size):
    """Blocks of texts of one language, with some near copies over the blocks."""
    from trustlake.functions import similarity as M

    words = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", range(26, 0, -1), k=rng.randint(2, 8))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([100, 400, 400]))) for _ in range(number * size)]
    for k in range(0, number * size, 17):
        texts[-1 - k] = " ".join(w if rng.random() < 0.85 else rng.choice(words) for w in texts[k].split())
    blocks = []
    for at in range(number):
        own = list(range(at * size, (at + 1) * size))
        parts = [M.compared_parts(texts[x]) for x in own]
        bags = [M._bags([p])[0] for p in parts]
        rows = pd.DataFrame({"id": [str(x) for x in own], "t": own, "o": own, "parts": parts, "lengths": [b.sum(axis=1) for b in bags], "bags": [b.astype("<i2").tobytes() for b in bags]})
        blocks.append(M.block_row(at, rows))
    near = {(a, b) for a in range(len(texts)) for b in range(a) if a + b == len(texts) - 1 and M.similarity(texts[a], texts[b]) >= 80}
    return blocks, near


def test_pairs_of_blocks_are_compared_side_by_side(monkeypatch):
    """Few pairs are left to be compared one by one, and those of several blocks are so together."""
    import random

    from trustlake.functions import similarity as M

    blocks, near = _mixed_blocks(random.Random(8), 3, 60)
    singly, calls, lengths, common = [], [], M._lengths, M.common_lengths
    monkeypatch.setattr(M, "_lengths", lambda a, b, kinds, i, j, *rest: singly.append(len(i)) or lengths(a, b, kinds, i, j, *rest))
    monkeypatch.setattr(M, "common_lengths", lambda *given: calls.append(given) or common(*given))
    rows = pd.DataFrame([x | {f"other_{k}": v for k, v in y.items()} for x in blocks for y in blocks if x["at"] <= y["at"]])
    out = pd.concat(M.close_pairs(80.0)([rows.iloc[:4], rows.iloc[4:]]))
    got = {(max(int(a), int(b)), min(int(a), int(b))) for a, b in zip(out["id"], out["head"], strict=True)}
    assert got >= near and len(near) >= 5 and all(a + b == 179 for a, b in got)
    assert max(singly) < 180 * 179 / 2 / 8 and len(calls) <= 3  # before, all pairs of some blocks and a call for each two blocks


def test_broken_links(spark):
    docs = pages(spark, {"content": "https://a.example/x and https://b.example/y http://localhost/z"}, {"content": "https://a.example/x"})
    assert {r.url for r in S.extracted_urls(docs).collect()} == {"https://a.example/x", "https://b.example/y"}
    probes = spark.createDataFrame([("https://a.example/x", 404, None), ("https://b.example/y", None, "timeout")], "url string, status_code int, error string")
    assert sorted((r.doc_id, r.message) for r in S.broken_links(docs, probes).collect()) == [("d0", "Broken link (404): https://a.example/x"), ("d1", "Broken link (404): https://a.example/x")]


LADDER = [
    ({"content": "Status: Current\nOwner: Ann B\nReview cadence: Quarterly\nLast reviewed: 2025-12-01\n"}, "current", 78, "current"),
    ({"content": "Status: Legacy\n"}, "stale", 30, "deprecated"),
    ({"content": "Status: Legacy\nCanonical: true\n"}, "needs_review", 30, "deprecated"),
    ({"content": "Status: unsupported\n"}, "unknown", 25, "supported"),
    ({"content": "Replaced by: Other\n"}, "stale", 65, "superseded"),
    ({"content": "Deprecated as of: 2024-01-01\n"}, "stale", 60, "deprecated"),
    ({"content": "x", "archived": True}, "stale", 30, "archived"),
    ({"content": "Status: Draft\n"}, "needs_review", 35, "draft"),
    ({"content": "Subject to change\n"}, "needs_review", 35, "experimental"),
    ({"content": "Last reviewed: 2024-01-01\n"}, "needs_review", 45, "unknown"),
    ({"content": "Status: Current\nReview cadence: weekly\nLast reviewed: 2025-12-01\n"}, "needs_review", 35, "current"),
    ({"content": "plain"}, "unknown", 25, "unknown"),
    ({"content": "plain", "age": None}, "unknown", 15, "unknown"),
    ({"content": "plain", "age": 200}, "needs_review", 45, "unknown"),
    ({"content": "do not use this\n"}, "stale", 30, "deprecated"),
    ({"title": "Guide (draft)", "content": "x"}, "needs_review", 35, "draft"),
]


def test_ladder(spark):
    given = [dict(p, id=f"p{n}", content=p["content"] + f"\n#{n}", title=p.get("title", f"Title {chr(97 + n)}")) for n, (p, *_) in enumerate(LADDER)]
    got = results(spark, *given, near_duplicates=False)
    for n, (p, status, hundredths, lifecycle) in enumerate(LADDER):
        r = got[f"p{n}"]
        assert (r.status, round(r.confidence * 100), r.trust_metadata.lifecycle) == (status, hundredths, lifecycle), (p, r.confidence_reason)


def test_promotion_and_stale_referrers(spark):
    got = results(
        spark,
        {"title": "Deploy Guide v1", "content": "alpha"}, {"title": "Deploy Guide v2", "content": "beta"}, {"title": "Deploy Guide v3", "content": "gamma"},
        {"title": "Hub", "content": "hub"}, {"title": "Old One", "content": "Status: Legacy\nSee Hub\n"}, {"title": "Old Two", "content": "Status: Retired\nSee Hub\n"},
    )
    v3, hub = got["d2"], got["d3"]
    assert (v3.status, v3.confidence) == ("current", 0.85) and v3.confidence_reason.startswith("Latest version among 3 related pages")
    assert (hub.status, hub.confidence) == ("needs_review", 0.5) and "from stale documents" in hub.trust_evidence.summary


def test_importance(spark):
    got = results(spark, {"title": "Core", "content": "Owner: Ann B\nStatus: Supported\n"}, {"title": "Bare", "content": "nothing"})
    core, bare = got["d0"].trust_metadata, got["d1"].trust_metadata
    assert (core.audit_priority, core.importance_score, core.requires_human_audit) == ("medium", 3, True)
    assert (bare.audit_priority, bare.requires_human_audit) == ("none", False)


@pytest.mark.parametrize("n", [1, 7])
def test_partitions_do_not_matter(spark, n):
    one = audit(demo(spark, NOW), Settings(NOW)).drop("doc_ord").orderBy("document_id").withColumn("trust_metadata", F.to_json("trust_metadata")).collect()
    two = audit(demo(spark, NOW).repartition(n, "title"), Settings(NOW)).drop("doc_ord").orderBy("document_id").withColumn("trust_metadata", F.to_json("trust_metadata")).collect()
    assert one == two


def test_empty(spark):
    assert audit(pages(spark), Settings(NOW)).count() == 0


def test_a_title_of_many_pages_is_one_row_for_its_referrers(spark, monkeypatch):
    monkeypatch.setattr(S, "LISTED", 50)
    n = 200
    docs = S.prepare(pages(spark, *[{"title": "Shared" if i % 2 else f"Own {i}", "content": "See Shared" if i % 3 else "nothing"} for i in range(n)], {"title": "Two v1"}, {"title": "Two v2", "content": "See Two"}))
    found = S.references(docs)
    shared = {f"d{i}" for i in range(1, n, 2)}
    rows = {r.doc_id: r for r in found.collect()}
    assert set(rows) == {f"d{i}" for i in range(n) if i % 3} | {f"d{n + 1}"}
    for i in (i for i in range(n) if i % 3):
        r = rows[f"d{i}"]
        count = len(shared - {r.doc_id})
        assert r.message == f"References 'Shared' which matches {count} documents" and r.details.matching_count == count
        assert r.details.matching_doc_ids is None and r.details.matching_class == "exact:shared"
    assert rows[f"d{n + 1}"].details.resolved_doc_id == f"d{n}"
    got = {}
    for r in S.matching_pages(found, docs).collect():
        got.setdefault(r.doc_id, set()).add(r.match_id)
    assert got == {f"d{i}": shared - {f"d{i}"} for i in range(n) if i % 3}


def test_one_class_row_serves_many_referrers_of_a_hot_title(spark, monkeypatch):
    monkeypatch.setattr(S, "LISTED", 2)
    docs = S.prepare(pages(spark, {"title": "T v1"}, {"title": "T v2"}, {"title": "T v3", "content": "See T"}, {"title": "T v4"}, {"content": "See T\nSee T v2"}))
    got = {(r.doc_id, *r.sig_ord): r for r in S.references(docs).collect()}
    assert got["d2", 0].details.matching_class == "base:t" and got["d2", 0].details.matching_count == 3
    assert got["d4", 0].details.matching_count == 4 and got["d4", 1].details.resolved_doc_id == "d1"
    results = audit(docs.select("doc_ord", "id", "title", "content", "source_type", "url", "last_modified", "archived", "metadata", "metadata_links", "links"), Settings(NOW))
    incoming = {r.document_id: r.incoming for r in reference_summary(results).collect()}
    assert incoming == {"d0": ["Page e", "T v3"], "d1": ["Page e", "Page e", "T v3"], "d2": ["Page e"], "d3": ["Page e", "T v3"], "d4": []}
