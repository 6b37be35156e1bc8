from collections import defaultdict

import pytest
from edges import docs, none
from pyspark.sql import functions as F

from trustlake.llm import mixing


def test_targets_by_hand():
    assert [float(t) for t in mixing.targets([100, 100, 100])] == [187.5, 75, 37.5]
    # the small source stops at three times its size; the excess goes to the others, five to one
    got = [float(t) for t in mixing.targets([10, 100, 1000])]
    assert got[0] == 30 and got[1] == 300 and got[2] == pytest.approx(780)
    assert sum(mixing.targets([7, 0, 9, 4])) == 20 and mixing.targets([7, 0, 9, 4])[1] == 0
    assert mixing.targets([]) == [] and [float(t) for t in mixing.targets([5])] == [5]


def test_quotas_are_split_exactly():
    q = [17, 0, 300, 5]
    out = mixing.split_quotas(q, 7)
    assert out.sum(axis=0).tolist() == q and (out >= 0).all()
    sizes = out.sum(axis=1)
    assert sizes.max() - sizes.min() <= 3
    assert (mixing.split_quotas(q, 7) == out).all()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.array_join(F.transform(F.sequence(F.lit(1), (F.pmod(F.xxhash64("id"), F.lit(40)) + 1).cast("int")), lambda x: F.lit("w")), " ").alias("text"),
        F.lit("en").alias("lang"),
        F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 100 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
    )
    return rows


def test_sources_come_near_their_targets(spark, corpus):
    meta = corpus.select(*mixing.sized(corpus, "text", "source", "doc_id"))
    rows = mixing.placements(meta, shards=5).select("id_", "source_", "size_", "source_size", "target", F.size("placed").alias("n"), "placed").collect()
    assert len(rows) == 3000
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        assert 0 <= r.n <= 3 and len({p["pass"] for p in r.placed}) == r.n
        by[r.source_][0] += r.size_ * r.n
        by[r.source_][1] += r.size_
        by[r.source_][2] = r.target
        assert 0 <= min([p["shard"] for p in r.placed], default=0) <= max([p["shard"] for p in r.placed], default=0) < 5
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    goal = mixing.targets([by[s][1] for s in order])
    for s, t in zip(order, goal, strict=True):
        assert by[s][2] == float(t) and abs(by[s][0] - t) <= max(2, 0.01 * float(t)), s
    again = mixing.placements(meta.repartition(7), shards=5).select("id_", "placed").collect()
    assert {r.id_: r.placed for r in again} == {r.id_: r.placed for r in rows}


def test_large_last_blocks_are_cut_and_fitted_as_near(spark, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "FIT_ROWS", 6)
    monkeypatch.setattr(mixing, "CUT", 4)
    meta = corpus.select(*mixing.sized(corpus, "text", "source", "doc_id"))
    rows = mixing.placements(meta).groupBy("source_", "target").agg(F.sum(F.col("size_") * F.size("placed")).alias("taken"), F.max(F.size("placed")).alias("most")).collect()
    for r in rows:
        assert abs(r.taken - r.target) <= max(20, 0.02 * r.target) and r.most <= 3, r


def test_one_large_document_among_small_ones(spark):
    rows = [(i, "w " * n, "en", "a") for i, n in enumerate([1, 1, 2, 3, 500, 90, 3, 40, 7, 7])] + [(100 + i, "w " * 50, "en", "b") for i in range(20)]
    meta = docs(spark, rows).transform(lambda d: d.select(*mixing.sized(d, "text", "source", "doc_id")))
    got = mixing.placements(meta).groupBy("source_").agg(F.sum(F.col("size_") * F.size("placed")).alias("taken"), F.first("target").alias("t")).collect()
    assert all(abs(r.taken - r.t) <= 30 for r in got)


def test_edges(spark):
    frame = docs(spark)
    mixed = mixing.mix(frame)
    assert mixed.columns[: len(frame.columns)] == frame.columns
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(n for i, n in counts.items() if i != 6) <= 3 and counts.get(6, 0) <= 6
    assert mixing.mix(none(spark)).count() == 0


def test_shards_are_written(spark, corpus, tmp_path):
    mixed = mixing.mix(corpus, shards=3)
    mixing.write_shards(mixed, f"file://{tmp_path}/mix", 3)
    back = spark.read.parquet(f"file://{tmp_path}/mix")
    assert back.count() == mixed.count() and {r[0] for r in back.select("mix_shard").distinct().collect()} == {0, 1, 2}


def test_rows_without_ids_and_of_one_id_are_taken_one_by_one(spark):
    same = [(None, "w " * 5, "en", "a")] * 700 + [(7, "w " * 5, "en", "b")] * 700  # wholly equal rows
    rows = [(None, f"w{i} " * (1 + i % 9), "en", "a") for i in range(500)] + [(7, f"w{i} " * (1 + i % 9), "en", "c") for i in range(500)]
    mixed = mixing.mix(docs(spark, same + rows))
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    sizes = {s: sum(len(t.split()) for _, t, _, x in same + rows if x == s) for s in "abc"}
    for s, t in zip("abc", mixing.targets([sizes[s] for s in "abc"]), strict=True):
        assert abs(taken.get(s, 0) - t) <= 9, (s, taken, float(t))
    assert mixed.count() == mixing.mix(docs(spark, same + rows)).count()
