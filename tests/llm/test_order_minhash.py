import hashlib
import random

import numpy as np
from edges import ROWS, docs, none

from trustlake.llm import order_minhash as O


def brute(text):
    """The signature by a plain reading of the method, with the module's hashes."""
    codes = O.code_points(text)
    grams = O._mix(O._grams(codes))
    n = len(grams)
    if not n:
        return [0] * O.SKETCHES
    shift, seen, items = max(20, n.bit_length()), {}, []
    for pos, g in enumerate(grams.tolist()):
        short = g >> shift
        occurrence = seen[short] = seen.get(short, -1) + 1
        value = int(O._mix(np.array([(short * 0x2545F4914F6CDD1D + occurrence) % (1 << 64)], np.uint64))[0])
        items.append((value, pos))
    out = []
    for x, t in zip(O._XOR.ravel().tolist(), O._TIMES.ravel().tolist(), strict=True):
        best = sorted(items, key=lambda i: ((i[0] >> 32 ^ x) * t) % (1 << 32))[: O.PICKED]
        total = len(best)
        for value, _ in sorted(best, key=lambda i: i[1]):
            total = int(O._mix(np.array([(total * 0x9E3779B97F4A7C15 + value) % (1 << 64)], np.uint64))[0])
        out.append(total >> 48)
    return out


def test_signature_matches_a_plain_reading():
    for text in ["", "short", "a" * 40, "the quick brown fox jumps " * 5, "Ünï😀" * 30]:
        assert O.signature(O.code_points(text)).tolist() == brute(text)


def test_long_texts_in_stretches(monkeypatch):
    text = " ".join(random.Random(1).choice(["one", "two", "three"]) for _ in range(700))
    whole = O.signature(O.code_points(text))
    monkeypatch.setattr(O, "_CHUNK", 64)
    assert (O.signature(O.code_points(text)) == whole).all()


def test_likeness_falls_with_edits_and_order():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    sketch = lambda ws: O.signature(O.code_points(" ".join(ws)))
    base = sketch(words)
    near = [O.likeness(base, sketch(words[:k] + words[k + 1 :])) for k in (10, 200)]
    half = O.likeness(base, sketch(words[:200] + ["zz" + w for w in words[200:]]))
    shuffled = O.likeness(base, sketch(words[200:] + words[:200]))
    assert min(near) > 0.9 > half > 0.05 and shuffled < min(near)
    assert O.likeness(base, sketch([w[::-1] + "q" for w in words])) < 0.05


def test_neighbours_in_order(spark):
    rng = random.Random(3)
    rows = [(i * 3, "".join(rng.choice("ab é😀") for _ in range(rng.randrange(50))), "en", "a") for i in range(97)]
    got = {r.doc_id: r for r in O.fingerprints(docs(spark, rows[::-1]).repartition(5)).collect()}
    assert len(got) == 97
    for n, (i, text, *_) in enumerate(rows):
        following = rows[(n + 1) % 97][1]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == O.signature(O.code_points(text)).astype(">u2").tobytes().hex()
        assert got[i].near_next == O.likeness(O.signature(O.code_points(text)), O.signature(O.code_points(following)))


def test_edges(spark):
    rows = O.fingerprints(docs(spark)).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].fingerprint == by[3].fingerprint and by[2].near_next == 1.0 and by[2].n_chars == 0
    assert O.fingerprints(none(spark)).count() == 0
    one = O.fingerprints(docs(spark, ROWS[:1])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_many_rows_of_one_id_are_several_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(None, f"text {i} of none", "en", "a") for i in range(300)] + [(7, f"text {i} of seven", "en", "a") for i in range(300)] + [(7, "the same", "en", "a")] * 20 + [(9, "last", "en", "a")]
    parts = O.neighbours(docs(spark, rows)).where("extra = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and max(r["count"] for r in parts) < 300
    got = O.fingerprints(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    # each row's follower is the next by id, hash of the text and text
    import zlib

    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()), r[1]))
    expected = []
    for n, (i, text, *_) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        expected.append((i or 0, hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((r.doc_id or 0, r.edited_sha256) for r in got) == sorted(expected)
