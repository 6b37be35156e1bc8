import math
import re

from edges import docs, none

from trustlake.llm import license_scan as L


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(text):
    w = words(text)
    places = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    labels, score = {x for _, x in places}, 1.0 if places else 0.0
    for s in range(0, max(0, len(w) - 33) + 1, 32):
        block = set(w[s : s + 64])
        for label, t in L._template_words().items():
            n = len(block & set(t))
            if n >= math.ceil(L.THRESHOLD * len(t)):
                labels.add(label)
                score = max(score, n / len(t))
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}), sorted(labels), score


TEXTS = [
    "Licensed under CC BY-NC 4.0. cc by cc by CC-BY", "All rights reserved. all rights reserved", "xx general public license yy General Public-License", "Licensed under the Apache License,\nVersion 2.0",
    "Licensed under the Apache License, Version 2.0", "version 2 0 " + "x " * 40 + "licensed under the apache license", "accby ccby cc  by", L.TEMPLATES["mit"].upper(), L.TEMPLATES["bsd"].replace("binary", "other"),
    "é " * 100 + L.TEMPLATES["isc"] + " w" * 300, "", None, "cc by", "by cc", "the gnu general public license version 3 licensed under",
    "# " + L.TEMPLATES["mit"].replace(" to any", "\n# to any").replace(" and associated", "\n# and associated"), "z " * 47 + L.TEMPLATES["mpl-2.0"].replace(" ", "\n * ", 9) + " z" * 90,
]


def test_matches_brute_force(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)]
    out = L.scan(docs(spark, rows))
    assert out.columns[:-1] == docs(spark).columns
    got = {r.doc_id: tuple(r.license_scan) for r in out.collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_rows_that_share_an_id_are_told_apart(spark):
    texts = ["Licensed under CC BY-NC 4.0", "plain words", "licensed under the\nGNU Affero General\nPublic License", "all rights reserved"]
    for id_ in (None, 7):
        rows = L.scan(docs(spark, [(id_, t, "en", "a") for t in texts])).collect()
        assert {r.text: tuple(r.license_scan) for r in rows} == {t: brute(t) for t in texts}
    found = L.matches(docs(spark, [(None, t, "en", "a") for t in texts])).collect()
    assert sorted((r.label, r.start, r.block) for r in found) == [("agpl", 0, "licensed under the gnu affero general public license"), ("cc-by-nc-4.0", 0, "licensed under cc by nc 4 0")]


def test_edges(spark):
    got = L.scan(docs(spark)).collect()
    assert len(got) == 10 and {r.license_scan.n_base for r in got} == {0}
    assert L.scan(none(spark)).count() == 0
    twice = L.scan(docs(spark, [(1, "cc by", "en", "a")] * 3)).collect()
    assert len(twice) == 3 and {r.license_scan.n_base for r in twice} == {1}


def test_a_long_text_of_notices_is_scanned_in_linear_time(spark):
    import time

    notice = L.TEMPLATES["mit"] + " and so on "
    took = []
    for n in (3_000, 12_000):
        began = time.time()
        (row,) = L.scan(docs(spark, [(1, notice * n, "en", "a")])).collect()
        took.append(time.time() - began)
        assert row.license_scan.labels == ["mit"] and row.license_scan.n_words == n * len(words(notice))
    assert took[1] < 6 * took[0] + 5, took
