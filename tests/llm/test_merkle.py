import random
from hashlib import sha256

from edges import docs, none
from pyspark.sql import functions as F

from trustlake.llm import merkle as M


def H(x):
    return sha256(x.encode()).hexdigest()


def leaf(*values):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """(root, proofs: a list of (place, run) for each node)."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(proofs, at, strict=True):
            p.append((i % 16, nodes[i // 16 * 16 : i // 16 * 16 + 16]))
        nodes, at = [H("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)], [i // 16 for i in at]
    return nodes[0], proofs


def brute(rows):
    """{(id, leaf): (subroot, root, siblings)} of rows (id, source, leaf)."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is not None, (s or "").encode()))
    mine = {s: sorted(((i, x) for i, q, x in rows if q == s), key=lambda r: (r[0] is not None, r)) for s in sources}
    trees = {s: tree([x for _, x in mine[s]]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = {}
    for s, top in zip(sources, tops, strict=True):
        for (i, x), proof in zip(mine[s], trees[s][1], strict=True):
            out.setdefault((i, x), []).append((trees[s][0], root, "".join(n for p, run in [*proof, *top] for k, n in enumerate(run) if k != p)))
    return out


def given(spark, rows, claimed=None):
    frame = spark.createDataFrame([(*r, None) for r in rows], "id long, source string, leaf string, claimed string")
    return frame.withColumn("claimed", claimed) if claimed is not None else frame


def matches(spark, rows):
    got = {}
    for r in M.manifest(given(spark, rows)).collect():
        assert M.folded(r.node, r.siblings, r.places, r.sizes) == r.root == r.folded
        got.setdefault((r.id, r.node), []).append((r.subroot, r.root, r.siblings))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in brute(rows).items()}


def test_matches_brute_force(spark):
    sizes = {None: 1, "": 2, "a": 16, "b": 17, "é": 256, "z": 257, "hot": 5000}
    matches(spark, [(i, s, H(f"{s} {i}")) for s, n in sizes.items() for i in random.Random(n).sample(range(10**6), n)])


def test_many_sources(spark):
    matches(spark, [(i, f"s{i % 300}", H(str(i))) for i in range(900)])


def test_odd_rows(spark):
    matches(spark, [(1, "a", H("x"))])
    same = [(5, "a", H("y"))] * 300 + [(None, "a", H(f"n{i}")) for i in range(300)] + [(5, "a", H(f"m{i}")) for i in range(40)]
    matches(spark, same)
    assert M.manifest(given(spark, []).where("false")).count() == 0


def test_leaf(spark):
    (row,) = spark.createDataFrame([(3, "é\n", None)], "a long, b string, c string").select(M.leaf([F.col(c) for c in "abc"]).alias("h")).collect()
    assert row.h == leaf(3, "é\n", None) == H("1:33:é\n-")


def test_tampering_is_seen(spark):
    rows = [(i, f"s{i % 3}", H(str(i))) for i in range(700)]
    bad = F.when(F.col("id") % 7 == 0, F.sha2(F.lit("forged"), 256))
    for r in M.manifest(given(spark, rows, bad)).collect():
        assert (r.folded == r.root) == (r.id % 7 != 0)
        assert r.folded == M.folded(H("forged") if r.id % 7 == 0 else r.node, r.siblings, r.places, r.sizes)


def test_query_and_edges(spark, tmp_path):
    frame = docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    for name, rows in (("some", frame), ("none", none(spark).withColumn("n_chars", F.lit(0).cast("long")))):
        rows.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
    got = M.op11_merkle_manifest(spark, f"file://{tmp_path}/some").collect()
    assert len(got) == frame.count()
    for r, d in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.leaf)), sorted(frame.collect(), key=lambda d: (d.doc_id or 0, leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text))), strict=True):
        assert r.leaf == leaf(d.doc_id, d.source, d.lang, d.n_chars, d.text)
    assert M.op11_merkle_manifest(spark, f"file://{tmp_path}/none").count() == 0
