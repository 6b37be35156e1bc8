"""Column functions against Python's own regular expressions and by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from trustlake.functions import text as T
from trustlake.functions.similarity import common_length, similarity, token_sort_ratio
from trustlake.functions.web import absolute, anchors, is_private, plain_text


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("x"))
    return [r.x for r in rows.orderBy("i").collect()]


@pytest.mark.parametrize(("title", "parts"), [
    ("Migration Guide 2021", ("migration guide", "2021", None)), ("HTTP 2000", ("http 2000", None, None)), ("Guide v1 2021", ("guide", "2021", None)),
    ("API Guide v2.1", ("api guide", "v2.1", None)), ("API Guide Version 3", ("api guide", "Version 3", None)), ("API Guide ( OLD ) ", ("api guide", None, "( OLD )")),
    ("API v1 (draft)", ("api", "v1", "(draft)")), ("  Plain  ", ("plain", None, None)), ("", ("", None, None)), ("v2", ("v2", None, None)), ("One Two 1800", ("one two 1800", None, None)),
])
def test_title_parts(spark, title, parts):
    assert tuple(column(spark, [title], T.title_parts)[0]) == parts


def test_adapter_title(spark):
    assert column(spark, ["KB Test Page v3", "API Guide (old)", "Guide version 2", "Guide 2021"], T.adapter_title) == ["kb test page", "api guide", "guide", "guide 2021"]


FIELDS = [
    "Status: Current\nOwner: Team A\n", "status :\n Legacy \r\nMaintained by: Ann\n", "x Status: no", "DRI: Bo B \n", "Owner: X\n", "Last reviewed: 2026-02-30", "LAST  REVIEWED: 2024-02-29 and more",
    "Superseded by: The New One\nDeprecated as of: 2024\n", "Canonical: YES\n", "Canonical: yes please\n", "", "Status:\nOwner: B Team\n",
]


def test_body_metadata_agrees_with_python(spark):
    flags = re.IGNORECASE

    def one(pattern, text):
        m = re.search(pattern, text, flags)
        return m.group(1).strip() if m else None

    got = column(spark, FIELDS, T.body_metadata)
    for text, pm in zip(FIELDS, got, strict=True):
        assert pm.status_text == one(r"(?:^|\n)\s*Status\s*[:]\s*(.+?)(?:\n|$)", text), text
        assert pm.owner == one(r"(?:^|\n)\s*(?:Owner|Maintained\s+by|DRI)\s*[:]\s*(\S.+?)(?:\n|$)", text), text
        assert pm.replaced_by == one(r"(?:^|\n)\s*(?:Replaced\s+by|Superseded\s+by)\s*[:]\s*(\S.+?)(?:\n|$)", text)
        assert pm.canonical == bool(re.search(r"(?:^|\n)\s*Canonical\s*[:]\s*(true|yes)\s*(?:\n|$)", text, flags))
    assert [str(pm.last_reviewed) for pm in got][5:7] == ["None", "2024-02-29"]


def test_scope(spark):
    got = column(spark, ["Version: v1\nScope: version=v2; region = EU ; color=red; plan=", "Scope: feature state=beta;version=a=b;version=c", ""], T.applicability)
    assert got == [{"version": "v1", "region": "EU"}, {"feature_state": "beta", "version": "a=b"}, {}]


def test_references(spark):
    text = "See: API Guide v2.1, then refer to Runbook; foresee problems here\nFor more details, see  Setup\nRefer  to: X"
    assert column(spark, [text], T.references) == [["API Guide v2", "problems here", "Setup", "Runbook", "X"]]


def test_error_redaction(spark):
    got = column(spark, ["Bearer abc.def token=xyz&a=1 password: p?w https://h/?api_key=k1&b=2", "x" * 600], T.sanitized_error)
    assert got[0] == "Bearer [REDACTED] token=[REDACTED]&a=1 password: [REDACTED] https://h/?api_key=[REDACTED]&b=2" and len(got[1]) == 500


def test_versions_and_urls(spark):
    rows = spark.createDataFrame([("Guide v2", "version 1.10 and V1.9"), ("Guide", "none"), ("G", "x" * 500 + " v9")], "t string, c string")
    assert [None if r[0] is None else [int(x) for x in r[0]] for r in rows.select(T.version_key(F.col("t"), F.col("c"))).collect()] == [[2], None, None]
    text = "go to (https://a.example/x). https://a.example/x https://www.notion.so/p http://b.example/y,"
    got = spark.createDataFrame([(text, ["http://c.example", "mailto:x"])], "c string, l array<string>").select(T.urls(F.col("c"), F.col("l"))).first()[0]
    assert got == ["http://c.example", "https://a.example/x", "http://b.example/y"]


def test_private_hosts():
    assert all(map(is_private, ["http://localhost:8", "https://x.localhost/a", "http://10.1.2.3/", "http://[::1]/", "http://169.254.1.1", "http://0.0.0.0"]))
    assert not any(map(is_private, ["https://example.com", "http://8.8.8.8/", "notaurl", "", "http://[bad"]))


def test_similarity():
    assert common_length("ABCBDAB", "BDCABA") == 4 and token_sort_ratio("b a", "a b") == 100 and token_sort_ratio("", " ") == 100
    assert similarity("x" * 3000, "x" * 3000) == 100 and 0 <= similarity("abc " * 400, "xyz " * 10) < 50


def test_markup():
    assert plain_text("<h1>A</h1><p>b<br>c</p><script>no</script><table><tr><td>1</td><td>2</td></tr></table>") == "A\n\nb\nc\n\n1 | 2 |"
    got = anchors('<p>Replaced by <a href="/x/y">New <b>One</b></a> now</p><a href="z">Z</a><li>open <a href="q">Q</a>', "https://h.example/wiki")
    assert got == [{"href": "https://h.example/x/y", "text": "New One", "context": "Replaced by New One now"}, {"href": "https://h.example/wiki/z", "text": "Z", "context": "Z"}]
    assert absolute("https://o.example/", "https://h.example") == "https://o.example/" and absolute("a", "") == "a"


def test_fields_read_from_their_lines_are_those_of_the_text(spark):
    rng = random.Random(3)
    parts = ["Status:", "status :", "Owner: Bob", "Maintained  by:", "DRI:x", "\n", "\n\n", " ", "Current", "Last reviewed: 2025-01-02 x", "Canonical: true", "Canonical: yes no", "Scope: region=eu; Version = 2", "Version: 3", "feature state: beta", "text", "Applies\nto: all", "Plan:\n\n  pro"]
    rows = [("".join(rng.choice(parts) + rng.choice(["", "\n", "\n"]) for _ in range(rng.randrange(1, 9))),) for _ in range(1500)]
    frame = spark.createDataFrame(rows, "c string").withColumn("l", T.field_lines(F.col("c")))
    both = [F.struct(T.body_metadata(F.col(x)).alias("m"), F.map_entries(T.applicability(F.col(x))).alias("s")) for x in ("c", "l")]
    wrong = frame.select("c", "l", both[0].alias("a"), both[1].alias("b")).where("not (a <=> b)").limit(5).collect()
    assert wrong == [] and frame.where("l <> ''").count() > 1000


def test_private_hosts_as_columns_equal_the_standard_library(spark):
    import ipaddress
    import random

    from trustlake.functions import addresses as A

    rng, hosts = random.Random(1), []
    for net in map(ipaddress.ip_network, (*A.HIDDEN_V4, *A.SHOWN_V4, *A.HIDDEN_V6, *A.SHOWN_V6, "64:ff9b:1::/48", "::ffff:0:0/96", "fec0::/10", "100.64.0.0/10")):
        low, high = int(net.network_address), int(net.broadcast_address)
        kind = type(net.network_address)
        for n in (low - 1, low, low + 1, high - 1, high, high + 1, rng.randint(low, high)):
            if 0 <= n < 1 << net.max_prefixlen:
                a = kind(n)
                hosts += [str(a)] if net.version == 4 else [f"[{a}]", f"[{a.exploded}]"]
    hosts += ["[::ffff:10.0.0.1]", "[::ffff:8.8.8.8]", "[64:ff9b::8.8.8.8]", "[2606:4700::1.2.3.4]", "[2606:4700:0:0:0:0:1.2.3.400]", "[2606:4700::01.2.3.4]", "[fe80::1%eth0]", "[2606::1%]", "[1::2::3]", "[1:2:3:4:5:6:7:8:9]", "[:1::2]", "[1:::2]", "[12345::]", "[g::]", "[::]", "[1:2:3:4:5:6:7::]"]
    hosts += ["256.1.1.1", "10.0.0", "010.0.0.1", "10.0.0.1.", "1.2.3.4.5", "LOCALHOST", "a.localhost", "localhost.example", "", "10.0.0.1:80", "user@10.0.0.1", "user:10.0.0.2@example.org", "[::1", "::1]", "x[::1]", "[::1]:8080"]
    urls = [f"{scheme}://{h}/p?q#f" for h in hosts for scheme in ("http", "HTTPS")] + ["10.0.0.1", "//10.0.0.1/x", "mailto:a@10.0.0.1", None, "http:/10.0.0.1/", "http://example.org/10.0.0.1", "http://example.org?x@10.0.0.1"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", A.private_host("u").alias("p")).collect()
    assert {r.u: r.p for r in rows} == {u: is_private(u) for u in urls}
    assert 0.2 < sum(r.p for r in rows) / len(rows) < 0.9


def test_lengths_in_common_at_the_ends_of_words():
    import random

    import numpy as np

    from trustlake.functions import similarity as M

    rng = random.Random(9)
    sizes = [0, 1, 62, 63, 64, 125, 126, 127, 190, 400]
    left = ["".join(rng.choices("abcde f", k=n)) for n in sizes] + ["a" * 200, "b" * 63 + "a"]
    right = ["".join(rng.choices("abcdxf ", k=n)) for n in reversed(sizes)] + ["a" * 130, "ab" * 80]
    codes, kinds = M._codes(left + right)
    i, j = (x.ravel() for x in np.indices((len(left), len(right))))
    exact = [M.common_length(left[a], right[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert M._lengths(codes[: len(left)], codes[len(left) :], kinds, i, j).tolist() == exact
    least = np.array([e + rng.choice([0, 40]) for e in exact])
    got = M.common_lengths(left, right, i, j, least)
    assert all(g == e if need <= e else g < need for g, e, need in zip(got.tolist(), exact, least.tolist(), strict=True))


def test_texts_are_cut_to_what_is_compared_before_they_are_shuffled(spark, sf):
    from trustlake import queries as Q
    from trustlake.functions import similarity as M

    rng = random.Random(4)
    texts = ["".join(rng.choices("ab \n\u00e9\u65e5\U0001f600", k=n)) for n in (0, 1, 999, 1000, 1001, 1999, 2000, 2999, 3000, 3001, 3002, 4001, 20_000)]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "k int, t string").select("k", M.compared_text(F.col("t")).alias("c")).collect()
    got = {r.k: r.c for r in rows}
    assert got.pop(len(texts)) is None and all(len(got[k]) <= 3 * M.WINDOW and M.compared_parts(got[k]) == M.compared_parts(t) for k, t in enumerate(texts))
    plan = Q.neighbour_similarity(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN (char_length(text") == 2, plan


def test_neighbours_score_as_single_pairs_do(spark, sf):
    from trustlake import queries as Q
    from trustlake.functions import similarity as M

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.similarity for r in Q.neighbour_similarity(spark, sf).collect()}
    assert got == {k: round(M.similarity(t, texts[k + 1]), 1) for k, t in texts.items() if k + 1 in texts}


def test_pairs_are_compared_by_the_characters_that_both_have(monkeypatch):
    from trustlake.functions import similarity as M

    rng = random.Random(5)
    kinds = ["abcdef  ", "abcxyz0123 ", "\u65e5\u672c\u8a9e\U0001f600 ", "ab"]
    texts = ["".join(rng.choices(rng.choice(kinds), k=rng.choice([0, 1, 5, 62, 63, 64, 127, 400, 999, 1000, 1001, 1500, 2500, 3000]))) for _ in range(150)] + [" ", "", "a", "a"]
    left, right = zip(*[(a, b) for a in texts for b in rng.sample(texts, 6)], strict=True)
    assert len(left) > M._TEXTS
    assert M.similarities(left, right).tolist() == pytest.approx([M.similarity(a, b) for a, b in zip(left, right, strict=True)], abs=1e-9)
    seen = []
    lengths = M._lengths
    monkeypatch.setattr(M, "_lengths", lambda a, b, *rest: seen.extend(map(len, [*a, *b])) or lengths(a, b, *rest))
    assert M.similarities(["xyz " * 200], ["abc " * 200]).tolist() == [M.similarity("xyz " * 200, "abc " * 200)] and seen == [199, 199]


def test_pairs_end_one_by_one():
    import numpy as np

    from trustlake.functions import similarity as M

    rng = random.Random(6)
    left = ["".join(rng.choices("abcdefgh ", k=n)) for n in (1000, 700, 64, 63, 1, 0)]
    right = ["".join(rng.choices("abcdefgh ", k=n)) for n in (0, 1, 50, 63, 64, 65, 128, 500, 700, 1000)]
    i, j = (x.ravel() for x in np.indices((len(left), len(right))))
    exact = np.array([M.common_length(left[a], right[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    assert M.common_lengths(left, right, i, j).tolist() == exact.tolist()
    for extra in (0, 1, 30):
        need = exact + np.where(np.arange(len(exact)) % 3 == 0, extra, 0)
        got = M.common_lengths(left, right, i, j, need)
        assert ((got == exact) | ((need > exact) & (got < need))).all()


def test_pairs_to_score_are_dealt_to_tasks_by_their_number(spark, sf, monkeypatch):
    from trustlake import queries as Q

    plan = lambda: Q.neighbour_similarity(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" not in plan() and "Broadcast" not in plan()
    monkeypatch.setattr(Q, "SCORED_ROWS", 20)  # of 200 rows
    assert plan().count(", 10), REPARTITION_BY_NUM") == 2 and Q.neighbour_similarity(spark, sf).count() == 199
