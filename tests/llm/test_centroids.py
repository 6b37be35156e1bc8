import random
from hashlib import sha256

import pytest

from trustlake.llm import centroids as C


def brute(rows, k=C.CLUSTERS, rounds=C.ROUNDS):
    near = lambda v, cs: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cs))
    rows = sorted(rows, key=lambda r: (sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in rows[:k]]
    for _ in range(rounds):
        mine = [near(v, cs)[1] for _, v in rows]
        for n in range(len(cs)):
            own = [v for (_, v), m in zip(rows, mine, strict=True) if m == n]
            if own:
                cs[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return sorted(((i or -1), *near(v, cs)[::-1]) for i, v in rows), cs


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-300, 300) // 40 * 40 for _ in range(5)]) for i in range(400)]  # many ties
    rows += [(7, rows[7][1]), (None, [1, 2, 3, 4, 5]), (None, [1, 2, 3, 4, 5]), (7, [0] * 5)]
    found, cs = C.lloyd(spark.createDataFrame(rows, "id long, v array<long>").repartition(5))
    assert (sorted((r.id or -1, r.cluster, r.distance) for r in found.collect()), cs.tolist()) == brute(rows)


def test_few_vectors_and_empty_clusters(spark):
    rows = [(1, [0, 0]), (2, [0, 0]), (3, [-5, 9])]
    found, cs = C.lloyd(spark.createDataFrame(rows, "id long, v array<long>"))
    assert (sorted((r.id, r.cluster, r.distance) for r in found.collect()), cs.tolist()) == brute(rows)
    found, cs = C.lloyd(spark.createDataFrame([], "id long, v array<long>"))
    assert found.count() == 0 and len(cs) == 0


def test_which_vectors_are_kept(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001, 2.0]), (2, [0.5, 1.0]), (3, [0.5, None, 1.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, [-inf, 1.0, 1.0]), (7, None), (8, []), (None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as id", "3 as cluster")
    assert sorted((r.id or 0, r.v) for r in C.quantized(frame, dimensions=3).collect()) == [(0, [64, 64, 64]), (1, [32, -1, 128])]


def test_too_large_components_raise(spark):
    with pytest.raises(Exception, match="beyond"):
        C.lloyd(spark.createDataFrame([(1, [1 << 40])], "id long, v array<long>"))


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert C.op12_centroids(spark, f"file://{tmp_path}").count() == 0
