import random

import numpy as np
import pytest
from edges import docs, none

from trustlake.llm import substring_dedup as D


def brute(rows, width=D.WINDOW):
    """{(id, text): (n_words, n_removed, kept)}: a window goes if it starts at a smaller (id, start); no id comes first."""
    rank = lambda i: -(1 << 63) if i is None else i
    split = [(rank(i), (t or "").encode().split(), (i, t)) for i, t in rows]
    first = {}
    for i, w, _ in split:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = {}
    for i, w, key in split:
        gone = {p for s in range(len(w) - width + 1) if first[tuple(w[s : s + width])] < (i, s) for p in range(s, s + width)}
        out[key] = (len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return out


def matches(spark, rows, **options):
    frame = docs(spark, [(i, t, "en", "a") for i, t in rows]).repartition(3)
    found = D.remove_repeats(frame, **options)
    assert found.columns[:-1] == frame.columns
    got = {}
    for r in found.collect():
        assert got.setdefault((r.doc_id, r.text), tuple(r.substring_dedup)) == tuple(r.substring_dedup)
    assert got == brute(rows, options.get("width", D.WINDOW))
    assert found.count() == len(rows)


def corpus(seed=1, vocabulary=7, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "bb", "é", "c d", "E,", "x" * 300, "日本"][:vocabulary])
    passage = [" ".join(word() for _ in range(rng.randrange(15, 60))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(25))), rng.choice(passage) if rng.random() < 0.7 else "", "\t\n".join(word() for _ in range(rng.randrange(9)))]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "\x0b", "  "]).join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_brute_force(spark, seed):
    matches(spark, corpus(seed))


def test_chunks_and_buckets_agree(spark, monkeypatch):
    monkeypatch.setattr(D, "CHUNK_BYTES", 700)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 2)
    matches(spark, corpus(5, 2))


def test_short_windows_that_overlap_themselves(spark):
    matches(spark, [(1, "a a a a a a b a a a a"), (2, "b a a a a"), (0, "a a"), (3, "")], width=3)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long + " end"), (6, "z " * 3000), (None, long[:600]), (None, long[:700]), (None, "q " * 30)]
    rows += [(7, long[900:1500])] * 3 + [(7, "other " + long[900:1500])] + [(8, "u v w\x1cx " * 12), (9, "u v w\x1cx " * 12)]
    matches(spark, rows)
    assert D.remove_repeats(none(spark)).count() == 0


def test_thousands_of_rows_without_ids(spark):
    rows = [(None, " ".join(f"w{(i * j) % 97}" for j in range(40))) for i in range(1000)]
    matches(spark, rows)


def test_word_hashes_are_those_of_the_words(monkeypatch):
    monkeypatch.setattr(D, "_SLICE", 64)
    rng = random.Random(2)
    text = " ".join(rng.choice(["a", "b" * 200, "cc", "a\0", "\0a", "d" * 65]) for _ in range(500)).encode() + b" "
    firsts, hashes = D.word_hashes(np.frombuffer(text, np.uint8))
    words = text.split()
    by = {}
    for f, h, w in zip(firsts.tolist(), hashes.tolist(), words, strict=True):
        assert text[f : f + len(w)] == w and by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_gaps_round_trip():
    for places in ([0], [5, 6, 7], [300, 301, 70_000, 70_255, 5_000_000], list(range(0, 255 * 255, 255)), [254, 254 + 255, 254 + 255 + 0xFFFFFF]):
        assert D._places(D._gaps(np.array(places))).tolist() == places
