"""Merkle manifest of a dataset by superblock reduction.

A row's leaf is the SHA-256 of its columns, each with its length in front. Leaves are numbered in each group (source) by id,
and while a group has several nodes every FANOUT neighbours become one. The groups' roots, in the groups' order, are reduced
in the same way to the dataset's root.

1. Numbering: rows of digests are range-partitioned by group, id and leaf and sorted; a row's number is its place in its
   partition plus the group's rows in the partitions before, which are counted in one small table.
2. Up: nodes are bucketed by number // FANOUT^LEVELS; a task collapses a bucket by LEVELS levels at once, and bucket roots are
   the nodes of the next round. A bucket never has more than FANOUT^LEVELS nodes, however large a group is.
3. Down: from the last round to the first each bucket meets the proof of its own root; a node's proof is its siblings
   inside the bucket (the lower part) followed by that (the upper part).

A proof is `siblings` (digests of each level's run without the node's own, level by level, left to right), `places` (the
node's place in each run) and `sizes` (the runs' lengths). `folded` recomputes a root from a leaf and a proof.

Defined results: a null column is `-` in a leaf; rows with a null id come first in their group, rows of one id go by leaf; repeated rows
are leaves of their own; a group of one row is its own root; the null group is the first; long texts are hashed whole; an empty
table has no rows and no root; other columns, whatever their names, take no part.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlake.llm.shared import lower_ascii, sized_hint, table, written

FANOUT = 16
LEVELS = 2  # of a bucket: FANOUT ** LEVELS nodes
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 64

PROOF = "siblings string, places array<int>, sizes array<int>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """The digest of some columns: `-` for null, else UTF-8 byte count, `:` and value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def indexed(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with `at`, their place in the sorted table; the ranges of that table), both written.

    A range is what one partition has of one group: part, base (the group's rows before it), first (its first `at`), total
    (the group's rows). A row's number in its group is base + at - first."""
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "merkle-sorted").withColumn("part", F.shiftright("at", 33))
    ranges = placed.groupBy(*group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    before = F.sum("n").over(whole.orderBy("part")) - F.col("n")
    return placed, written(ranges.select(*group, "part", "first", before.alias("base"), F.sum("n").over(whole).alias("total")), "merkle-ranges")


def _bucketed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", F.expr(f"number div {FANOUT**LEVELS}"))


def _levels(nodes: list[str], total: int) -> list[list[str]]:
    """A bucket's nodes and those of each level above, up to LEVELS or the root of its tree; total: the tree's nodes in all."""
    out = [nodes]
    for _ in range(LEVELS):
        if total == 1:
            break
        nodes, total = [digest("".join(nodes[i : i + FANOUT])) for i in range(0, len(nodes), FANOUT)], -(-total // FANOUT)
        out.append(nodes)
    return out


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (tree, number, total, node) and those of each round of reduction; in the last all trees are roots."""

    def collapsed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, bucket, total = key
        top = _levels(pdf.sort_values("number")["node"].tolist(), total)[-1]
        return pd.DataFrame({"tree": [tree], "number": [bucket], "total": [-(-total // FANOUT**LEVELS)], "node": top})

    out = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 1
    while most > 1:
        some = _bucketed(out[-1].where("total > 1")).select("tree", "bucket", "total", "number", "node")
        out.append(written(some.groupBy("tree", "bucket", "total").applyInPandas(collapsed, "tree long, number long, total long, node string"), "merkle-nodes"))
        most = -(-most // FANOUT**LEVELS)
    return out


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, node) of each tree's root."""
    found = levels[0].where("total = 1").select("tree", "node")
    for nodes in levels[1:]:
        found = found.unionByName(nodes.where("total = 1").select("tree", "node"))
    return found


def proven(levels: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The columns of the first round's nodes with `siblings`, `places`, `sizes`, `subroot`, `root` and, if the nodes have a column
    `claimed`, `folded` of that digest (of the node where it is null). ends: (tree, subroot, root, siblings, places, sizes) of the trees' own roots."""
    shape = f"{PROOF}, subroot string, root string"

    def put(nodes: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        nodes, above = nodes.sort_values("number").reset_index(drop=True), upper.iloc[0]
        total = int(nodes["total"].iloc[0])
        inside = _levels(nodes["node"].tolist(), total)
        runs = [["".join(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)] for level in inside[:-1]]
        tail = [(int(p), int(n)) for p, n in zip(above["places"], above["sizes"], strict=True)]
        claims = nodes["claimed"].tolist() if "claimed" in nodes else None
        siblings, places, sizes, folds = [], [], [], []
        for i in range(len(nodes)):
            own, lower, steps = i, [], []
            for level in runs:
                run, own = level[own // FANOUT], own
                at = own % FANOUT
                lower += [run[: at * _DIGEST], run[(at + 1) * _DIGEST :]]
                steps.append((at, len(run) // _DIGEST))
                own //= FANOUT
            steps += tail
            siblings.append("".join(lower) + above["siblings"])
            places.append([p for p, _ in steps])
            sizes.append([n for _, n in steps])
            if claims is not None:
                folds.append(folded(claims[i] or nodes["node"][i], siblings[-1], places[-1], sizes[-1]))
        nodes = nodes.assign(siblings=siblings, places=places, sizes=sizes, subroot=above["subroot"], root=above["root"])
        return nodes.assign(folded=folds) if claims is not None else nodes

    def columns(nodes: DataFrame) -> str:
        own = ", ".join(f"`{n}` {t}" for n, t in nodes.dtypes)
        return f"{own}, {shape}" + (", folded string" if "claimed" in nodes.columns else "")

    found = None
    for r in range(max(1, len(levels) - 1))[::-1]:
        # a bucket's own root is its tree's root, or a node of the next round
        ended = [levels[r + 1].where("total = 1").select("tree")] if r + 1 < len(levels) else []
        ended += [levels[0].where("total = 1").select("tree")] if r == 0 else []
        upper = ends.join(reduce(DataFrame.union, ended).select(F.col("tree").alias("ended")), F.col("tree") == F.col("ended")).drop("ended")
        upper = upper.select(*[F.col(c).alias(c) for c in upper.columns], F.lit(0).cast("long").alias("bucket"))  # columns of their own: one row may be both
        if found is not None:
            upper = upper.unionByName(found.select("tree", F.col("number").alias("bucket"), "subroot", "root", "siblings", "places", "sizes"))
        some = _bucketed(levels[r] if r == 0 else levels[r].where("total > 1"))
        found = some.groupBy("tree", "bucket").cogroup(upper.groupBy("tree", "bucket")).applyInPandas(put, columns(some)).drop("bucket")
        if r:
            found = written(found, "merkle-proofs")
    return found


def folded(node: str, siblings: str, places: list[int], sizes: list[int]) -> str:
    """The root that a digest leads to by a proof."""
    at = 0
    for place, size in zip(places, sizes, strict=True):
        left, end = at + place * _DIGEST, at + (size - 1) * _DIGEST
        node, at = digest(siblings[at:left] + node + siblings[left:end]), end
    return node


def manifest(rows: DataFrame) -> DataFrame:
    """rows (id, source, leaf and perhaps `claimed`) with number, total, subroot, root and the proof of each; see proven."""
    rows = written(rows.withColumn("source", F.col("source").cast("string")), "merkle-leaves")
    placed, ranges = indexed(rows, ["source"], ["id", "leaf"])
    sources, spans = indexed(ranges.select("source").distinct(), [], ["source"])
    trees = sources.join(F.broadcast(spans.select("part", F.col("first").alias("from"), "base", F.col("total").alias("trees"))), "part")
    trees = written(trees.select(F.col("source").alias("name"), (F.col("base") + F.col("at") - F.col("from")).alias("tree"), "trees"), "merkle-trees")
    ranges = ranges.join(sized_hint(trees), ranges.source.eqNullSafe(trees.name)).select(F.col("source").alias("name"), F.col("part").alias("part_"), "first", "base", "total", "tree")
    ranges = written(ranges, "merkle-starts")
    nodes = placed.join(sized_hint(ranges), placed.source.eqNullSafe(ranges.name) & (F.col("part") == F.col("part_")))
    number = (F.col("base") + F.col("at") - F.col("first")).alias("number")
    extra = [c for c in ("claimed",) if c in rows.columns]
    nodes = written(nodes.select("tree", number, "total", F.col("leaf").alias("node"), "id", *extra), "merkle-nodes")

    levels = rounds(nodes)
    subroots = written(roots(levels), "merkle-subroots")
    tops = subroots.join(sized_hint(trees.select("tree", "trees")), "tree")
    tops = rounds(written(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("number"), F.col("trees").alias("total"), "node"), "merkle-tops"))
    none = F.array().cast("array<int>")
    ends = roots(tops).select(F.col("tree").alias("tree"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"), F.lit("").alias("siblings"), none.alias("places"), none.alias("sizes"))
    ends = proven(tops, ends).select(F.col("number").alias("tree"), F.col("node").alias("subroot"), "root", "siblings", "places", "sizes")
    return proven(levels, written(ends, "merkle-ends"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    own = {c: F.col(c) for c in COLUMNS}
    altered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    claimed = F.when(altered, leaf(list((own | {"text": lower_ascii(F.col("text"))}).values())))
    found = manifest(docs.select(F.col("doc_id").alias("id"), "source", leaf(list(own.values())).alias("leaf"), claimed.alias("claimed")))
    return found.select(
        F.col("id").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


_SQL_LEVELS = 6  # of each tree: enough for 16 ** 6 rows a source and as many sources


def _oracle() -> str:
    """Level by level: a tree's nodes with their runs, then each leaf's siblings left and right of its own node."""
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    columns = lambda text: " || ".join(value(text if c == "text" else c) for c in COLUMNS)
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    bits = "flatten(list_transform(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)), lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    parts = [f"""d AS (SELECT doc_id, source, sha256({columns("text")}) AS leaf, CASE WHEN {crc} % 5 = 0 THEN sha256({columns(low)}) END AS claimed FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d),
s AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS t, count(*) OVER () AS trees FROM (SELECT DISTINCT source FROM d)),
a0 AS (SELECT t, i, n, leaf AS node FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source)"""]

    def tree(name: str) -> None:
        for k in range(_SQL_LEVELS):
            parts.append(f"{name}{k + 1} AS (SELECT t, i // {FANOUT} AS i, CAST(CASE WHEN n > 1 THEN ceil(n / {FANOUT}) ELSE 1 END AS BIGINT) AS n, CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY i)) ELSE any_value(node) END AS node FROM {name}{k} GROUP BY t, i // {FANOUT}, n)")

    tree("a")
    parts.append(f"b0 AS (SELECT 0 AS t, a.t AS i, trees AS n, node FROM a{_SQL_LEVELS} a JOIN s USING (t))")
    tree("b")
    parts.append(f"f0 AS (SELECT o.doc_id, o.leaf, s.t, o.i, s.t AS u, a.node AS subroot, coalesce(o.claimed, o.leaf) AS f, '' AS p FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source JOIN a{_SQL_LEVELS} a ON a.t = s.t)")
    at = 0
    for name, place, mine in (("a", "i", "x.t"), ("b", "u", "0")):
        for k in range(_SQL_LEVELS):
            own = f"x.{place} // {FANOUT**k}"
            side = lambda op: f"coalesce(string_agg(y.node, '' ORDER BY y.i) FILTER (y.i {op} {own}), '')"  # noqa: B023, E731
            keys = ", ".join(f"x.{c}" for c in ("doc_id", "leaf", "t", "i", "u", "subroot", "f", "p"))
            parts.append(f"""g{at} AS (SELECT {keys}, {side("<")} AS l, {side(">")} AS r, max(y.n) AS n FROM f{at} x JOIN {name}{k} y ON y.t = {mine} AND y.i // {FANOUT} = {own} // {FANOUT} GROUP BY {keys}),
f{at + 1} AS (SELECT doc_id, leaf, t, i, u, subroot, CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f, CASE WHEN n > 1 THEN p || l || r ELSE p END AS p FROM g{at})""")
            at += 1
    return f"WITH {',\n'.join(parts)}\nSELECT doc_id, leaf, subroot, node AS root, sha256(p) AS proof_sha256, f AS folded_root, f = node AS verified FROM f{at}, b{_SQL_LEVELS}"


ORACLE = _oracle()
