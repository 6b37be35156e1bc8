import random
import re

import xxhash
from edges import ROWS, docs, none
from pyspark.sql import functions as F

from trustlake.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_components(values):
    distinct = sorted(set(values))
    parent = {x: x for x in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {x: find(x) for x in distinct}


def test_fingerprints_match_a_plain_reading():
    for _, text, _, _ in ROWS:
        assert simhash.signature(text.encode() if text else None) == signed(plain(text))


def test_every_pair_in_reach_shares_a_table():
    masks = simhash.covering_masks()
    for i in range(64):
        for j in range(64):
            changed = 1 << i | 1 << j
            assert any(not changed & m for m in masks)


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    values = []
    for _ in range(40):  # chains, stars and dense balls
        x = rng.getrandbits(64)
        values.append(x)
        for _ in range(rng.choice([0, 0, 3, 12])):
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.append(x)
    ball = rng.getrandbits(64)
    values += [ball ^ 1 << i for i in range(64)] + [ball ^ 1 << i ^ 1 << i + 1 for i in range(63)]
    rows = [(n, signed(v)) for n, v in enumerate(values)]
    marked = spark.createDataFrame(rows, "doc_id long, fingerprint long")
    got = {r.fp: r.component_id for r in simhash.component_ids(marked, "fingerprint", "doc_id").collect()}
    roots = brute_components([v for _, v in rows])
    least = {}
    for n, v in rows:
        least[roots[v]] = min(n, least.get(roots[v], n))
    assert got == {v: least[roots[v]] for v in got}


def test_edges_and_one_of_each_group_stays(spark):
    frame = docs(spark)
    found = simhash.classes(frame).collect()
    assert len(found) == len(ROWS)
    by = {r.doc_id: r for r in found}
    assert by[2].fingerprint == by[3].fingerprint == by[4].fingerprint == 0
    assert by[2].component_id == by[4].component_id == 2
    assert by[6].component_id == 1
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None) == [1, 2, 5, 7, 8]
    assert simhash.keep_one(none(spark)).count() == 0
    assert simhash.classes(none(spark)).count() == 0


def test_a_group_of_repeats_keeps_one_row(spark):
    frame = docs(spark, [(9, "same text here today", "en", "a")] * 5).withColumn("x", F.lit("y"))
    assert simhash.keep_one(frame).count() == 1
