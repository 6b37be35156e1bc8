"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, one sign per bit over the XXH64 of all 3-word shingles. Two fingerprints
link at RADIUS or fewer differing bits. Covering LSH gives every bit position a vector of RADIUS + 1
bits; table v (v not zero) keeps the positions whose vector has an odd product with v. For any RADIUS
positions some v has an even product with all of them, so each linked pair agrees on the kept bits of
some table: no pair is missed.

Inside a bucket pairs are not spelt out. Two members differ in left-out bits only, and are linked just
if some value lies within one bit of both. Each member therefore names itself and its one-bit
neighbours, and members that name the same value form a star. A value is named by at most 65 fingerprints, so
no group is large however many members a bucket has.

Defined results: null, empty and blank texts have no word and the fingerprint zero, which links like any other;
repeated rows and equal texts share a fingerprint; a null id never becomes a component's id unless all
its ids are null; an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlake.llm.shared import free_name, slices, sized_hint, table, written

RADIUS = 2
SHINGLE = 3
_BITS = 64
_ROWS = 255  # as many 0/1 rows as a byte can sum


def signature(raw: bytes | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one UTF-8 text, as a signed integer."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    totals = np.zeros(_BITS, np.int64)
    for at in range(0, n, _ROWS * 64):
        rows = hashes[at : at + _ROWS * 64].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        whole = len(bits) // _ROWS * _ROWS
        if whole:
            totals += bits[:whole].reshape(-1, _ROWS, _BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        totals += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(totals * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """The signed 64-bit fingerprint of a text column."""

    @F.arrow_udf("long")
    def signatures(texts: pa.Array) -> pa.Array:
        return pa.array([signature(x, width) for some in slices(texts) for x in some.cast(pa.binary()).to_pylist()], pa.int64())

    return signatures(text)


def covering_masks(radius: int = RADIUS, bits: int = _BITS) -> list[int]:
    """The kept bits of each covering table, as unsigned integers."""
    side = 2 ** (radius + 1)
    vectors = [1 + i % (side - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, side)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, over distinct fingerprints `fp`, whose components are those of all linked pairs."""
    masks = covering_masks()
    tables = F.explode(F.array(*[F.struct(F.lit(t).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)]))
    members = nodes.select("fp", tables.alias("x")).select("fp", "x.t", "x.key")
    shared = members.groupBy("t", "key").count().where("count > 1").select("t", "key")
    members = written(members.join(shared, ["t", "key"], "left_semi"), "simhash-members")
    left_out = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(_BITS) if not m >> i & 1]) for m in masks])
    named = members.select("fp", F.explode(F.element_at(left_out, F.col("t").cast("int") + 1)).alias("flip"))
    named = named.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value")).distinct()
    lowest = F.min("fp").over(Window.partitionBy("value"))
    return named.select(F.col("fp").alias("a"), lowest.alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the component's least node.

    Alternating large-star and small-star steps; each halves long chains and is written to the shared
    folder. A node's least neighbour is aggregated before the join, and a hot node is split by AQE. It ends when
    a round leaves every edge as it was."""
    edges = written(edges.select("a", "b"), "cc-edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct(), "cc-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), "cc-small")
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        # equal sums only hint at equal edges; both sides are distinct, so no edge that is new and equal numbers prove it
        if before and now == before[1] and not edges.subtract(before[0]).limit(1).count():
            break
        before = edges, now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def rooted(marked: DataFrame, fp: str, id_col: str) -> DataFrame:
    """(fp, least_id, root) for each distinct fingerprint of marked, written: its least id and its component's least fingerprint."""
    nodes = written(marked.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("least_id")), "simhash-nodes")
    root = components(links(nodes.select("fp")))
    of = nodes.join(root, nodes.fp == root.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    return written(of, "simhash-roots")


def component_ids(marked: DataFrame, fp: str, id_col: str) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint of marked: the least id that links lead to."""
    of = rooted(marked, fp, id_col)
    least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return of.join(least, "root").select("fp", "component_id")


def _marked(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id_col, fingerprint) of every row, written."""
    return written(docs.select(F.col(id_col), fingerprint(F.col(text_col)).alias("fingerprint")), "simhash-docs")


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: its id, `fingerprint` (signed long) and `component_id`."""
    marked = _marked(docs, text_col, id_col)
    found = component_ids(marked, "fingerprint", id_col)
    return marked.join(found, marked.fingerprint == found.fp, "left").drop("fp")


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that remain: of each component one row, the first by id, null ids last.

    Which rows go is settled on ids and fingerprints alone, and texts are fingerprinted once. Rows whose id no other row
    has are then told by it; of rows that share an id or have none, the kept fingerprint's least row is aggregated."""
    marked = _marked(docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), "text_", "id_")
    of = rooted(marked, "fingerprint", "id_")
    first = of.groupBy("root").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "fp")).alias("k"))
    first = first.select(F.col("k.least_id").alias("kept_id"), F.col("k.fp").alias("kept_fp"))
    pairs = marked.groupBy("id_", "fingerprint").agg(F.count("*").alias("n"))
    pairs = pairs.join(first, pairs.id_.eqNullSafe(first.kept_id) & (pairs.fingerprint == first.kept_fp), "left")
    ids = pairs.groupBy("id_").agg(F.sum("n").alias("n"), F.max(F.col("kept_fp").isNotNull()).alias("kept"))
    shared = (F.col("n") > 1) | F.col("id_").isNull()
    aside = written(ids.where(shared | ~F.col("kept")).select("id_", shared.alias("shared")), "simhash-aside")
    name = free_name(docs, "aside_")
    out = docs.where(F.col(id_col).isNotNull()).join(sized_hint(aside.select(F.col("id_").alias(name))), F.col(id_col) == F.col(name), "left_anti")
    again = aside.where("shared").select(F.col("id_").alias(name))
    if not again.limit(1).count():
        return out
    row, fp = free_name(docs, "row_"), free_name(docs, "fp_")
    rows = docs.join(sized_hint(again), docs[id_col].eqNullSafe(again[name]), "left_semi")
    rows = rows.select(F.struct(*docs.columns).alias(row), F.col(id_col).alias(name), F.col(text_col).alias("text_"), fingerprint(F.col(text_col)).alias(fp))
    rows = rows.join(first, rows[name].eqNullSafe(first.kept_id) & (rows[fp] == first.kept_fp), "left_semi")
    rows = rows.groupBy(name, fp).agg(F.min_by(row, F.struct("text_")).alias(row))
    return out.unionByName(rows.select(*[F.col(row)[c].alias(c) for c in docs.columns]))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
