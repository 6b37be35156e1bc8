"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every document gets a size in words and a pseudo-random place (a hash of its id and text), which cuts its
   source into permuted blocks. A source has at most MAX_BLOCKS blocks, so block tables are bounded by the
   number of sources and not by the number of documents.
2. Targets: sources in code point order (null last) weigh 5, 2, 1 in turn and share the total size; a
   target stops at CAP times its source's size and the excess goes to the others by weight.
3. A source gives floor(target / size) whole passes and then whole blocks in permuted order while they
   fit. The one block that does not fit is cut into CUT smaller ones, of which again those are taken that fit, until
   the one left has at most FIT_ROWS documents; there they are taken in permuted order, each if it still fits,
   and exchanged one at a time while that brings the source nearer to its target.
4. The block draws of all sources are split over the output shards: at each node of a binary tree
   the left half's share is one multivariate-hypergeometric draw from the node's block quotas. Leaves
   have exact quotas; each then takes the next blocks of the source's permuted draws, so draws are disjoint.
5. Inside a shard rows are ordered by a hash of row and pass: the local shuffle.

Defined results: null and empty texts have size 0 and add nothing; a source without words has target 0;
rows are taken one by one, also where ids are null or shared: those of one id and text are written once with numbers of their
own, which tell their places apart; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlake.llm.shared import SPACE_WORD, free_name, sized_hint, table, written

WEIGHTS = (5, 2, 1)
CAP = 3
#: Shards have some SHARD_WORDS words (about 1 GB); there are at least SHARDS, and each has at least DRAWS block draws to choose from.
SHARDS = 16
SHARD_WORDS = 200_000_000
DRAWS = 8
MAX_BLOCKS = 1024
BLOCK_DOCS = 512
SEED = 20240229
#: The source table is held on the driver; more sources than this raise an error.
MAX_SOURCES = 100_000
#: Rows of one block whose documents are fitted singly, in one task a source; a larger block is cut into CUT first.
FIT_ROWS = 20_000
CUT = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> list[Fraction]:
    """Each source's target: shares of sum(sizes) by weight, none above cap times its size."""
    share = [Fraction(weights[i % len(weights)]) for i in range(len(sizes))]
    out: list[Fraction] = [Fraction(0)] * len(sizes)
    left, rest = set(range(len(sizes))), Fraction(sum(sizes))
    while left:
        total = sum(share[i] for i in left)
        above = [i for i in left if rest * share[i] / total > cap * sizes[i]]
        if not above:
            for i in left:
                out[i] = rest * share[i] / total
            break
        for i in above:
            out[i] = Fraction(cap * sizes[i])
        left -= set(above)
        rest -= sum(out[i] for i in above)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """shards x sources: how many block draws of each source go to each shard; columns sum to quotas."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, node: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = node
            return
        mid, total = (lo + hi) // 2, int(node.sum())
        rng = np.random.Generator(np.random.Philox([seed, lo, hi]))
        left = rng.multivariate_hypergeometric(node, total * (mid - lo) // (hi - lo), method="marginals")
        split(lo, mid, left)
        split(mid, hi, node - left)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def _fits(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows (s, place, size, n, room) of one source's last block: those that are taken.

    In permuted order each unit is taken if it still fits; then the add, drop or swap that comes nearest to
    the room is made as long as one comes nearer."""
    pdf = pdf.sort_values(["place", "size"], kind="stable")
    words = pdf["size"].to_numpy(np.int64) * pdf["n"].to_numpy(np.int64)
    room, taken = int(pdf["room"].iloc[0]), np.zeros(len(pdf), bool)
    for i, n in enumerate(words.tolist()):
        if n <= room:
            taken[i], room = True, room - n
    while room:
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken)
        outside = outside[np.argsort(words[outside], kind="stable")]
        none = np.full(max(len(inside), len(outside)), -1)
        drops, adds = [none[: len(outside)], inside], [outside, none[: len(inside)]]
        if len(inside) and len(outside):
            at = np.searchsorted(words[outside], words[inside] + room)
            drops += [inside, inside]
            adds += [outside[np.minimum(at, len(outside) - 1)], outside[np.maximum(at - 1, 0)]]
        drop, add = np.concatenate(drops), np.concatenate(adds)
        gain = np.where(add < 0, 0, words[add]) - np.where(drop < 0, 0, words[drop])
        best = int(np.abs(room - gain).argmin())
        if abs(room - int(gain[best])) >= abs(room):
            break
        room -= int(gain[best])
        if drop[best] >= 0:
            taken[drop[best]] = False
        if add[best] >= 0:
            taken[add[best]] = True
    return pdf.loc[taken, ["s", "place", "size"]]


def _edge_units(units: DataFrame, seed: int) -> DataFrame:
    """(s, place, size) of the units that are taken of each source's block that does not fit whole.

    units: (s, place, size, n, room) of those blocks. As long as one has over FIT_ROWS units, all are cut by further hashes: pieces that fit are taken in order, and the first that does not is looked at next, with the room that is left."""
    kept, level = None, 0
    while (units.groupBy("s").count().agg(F.max("count")).first()[0] or 0) > FIT_ROWS:
        level += 1
        units = units.withColumn("piece", F.pmod(F.xxhash64("place", "size", F.lit(seed + level)), F.lit(CUT)).cast("int"))
        order = Window.partitionBy("s").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)  # at most CUT rows a source
        pieces = units.groupBy("s", "room", "piece").agg(F.sum(F.col("size") * F.col("n")).alias("words")).withColumn("upto", F.sum("words").over(order))
        left = F.col("room") - F.col("upto") + F.col("words")
        pieces = written(pieces.where(left > 0).select("s", "piece", left.alias("left"), (F.col("upto") <= F.col("room")).alias("fits")), "mix-pieces")
        cut = written(units.drop("room").join(sized_hint(pieces), ["s", "piece"]), "mix-cut")
        whole = cut.where("fits").select("s", "place", "size")
        kept = whole if kept is None else kept.union(whole)
        units = cut.where("not fits").select("s", "place", "size", "n", F.col("left").alias("room"))
    fitted = units.groupBy("s").applyInPandas(_fits, "s int, place long, size long")
    return fitted if kept is None else kept.union(fitted)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with `row_`: 0 for a row whose id and text no other row has, else a number of its own.

    Only rows that repeat are written, as their numbers follow the partitioning and are read twice."""
    id_, text = F.col(id_col).cast("string"), F.xxhash64(F.col(text_col))
    again = docs.groupBy(id_.alias("again_id"), text.alias("again_text")).count().where("count > 1")
    again = written(again.select("again_id", "again_text"), "mix-again")
    if not again.limit(1).count():
        return docs.withColumn("row_", F.lit(0).cast("long"))
    again = sized_hint(again)
    same = id_.eqNullSafe(F.col("again_id")) & (text == F.col("again_text"))
    repeated = written(docs.join(again, same, "left_semi").withColumn("row_", F.monotonically_increasing_id() + 1), "mix-repeated")
    return docs.join(again, same, "left_anti").withColumn("row_", F.lit(0).cast("long")).unionByName(repeated)


def placements(rows: DataFrame, shards: int | None = None, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, meta: DataFrame | None = None) -> DataFrame:
    """rows (with the columns of `sized`: id_, text_, row_, source_, size_) with source_size, target and
    `placed`, an array of (pass, shard), one for each time the mix takes the row. shards: their number, else by size. meta: the same rows without
    other columns, already written."""
    spark = rows.sparkSession
    meta = rows.select("id_", "text_", "row_", "source_", "size_") if meta is None else meta
    known = meta.groupBy("source_").agg(F.sum("size_").alias("n"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(known) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    known.sort(key=lambda r: (r.source_ is None, (r.source_ or "").encode()))
    goal = targets([r.n for r in known], weights, cap)
    plan = []
    for i, (r, t) in enumerate(zip(known, goal, strict=True)):
        whole = floor(t / r.n) if r.n else 0
        blocks = min(MAX_BLOCKS, -(-r.docs // BLOCK_DOCS))
        plan.append((i, r.source_, r.n, float(t), whole, floor(t - whole * r.n), blocks))
    sources = spark.createDataFrame(plan, "s int, source string, source_size long, target double, whole int, room long, blocks int")
    place = F.xxhash64(F.coalesce(F.col("id_").cast("string"), F.lit("")), "text_", "row_", F.lit(seed))

    def dealt(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(sources), df.source_.eqNullSafe(sources.source), "inner").drop("source").withColumn("place", place)
        return df.withColumn("block", F.shiftright(F.shiftrightunsigned("place", 33) * F.col("blocks"), 31).cast("int"))

    units = dealt(meta).groupBy("s", "whole", "room", "block", "place", F.col("size_").alias("size")).agg(F.count("*").cast("int").alias("n"))
    units = written(units, "mix-units")
    order = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    blocks = units.groupBy("s", "whole", "room", "block").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    blocks = written(blocks.withColumn("upto", F.sum("words").over(order)), "mix-blocks")
    whole = F.col("whole") + (F.col("upto") <= F.col("room")).cast("int")
    part = (F.col("upto") > F.col("room")) & (F.col("upto") - F.col("words") < F.col("room"))
    blocks = blocks.select("s", "block", "whole", F.when(part, F.col("room") - F.col("upto") + F.col("words")).alias("room"), (whole + part.cast("int")).alias("passes"))
    edge = blocks.where("room is not null").select("s", "block", "room")
    fitted = written(units.drop("room").join(F.broadcast(edge), ["s", "block"]).select("s", "place", "size", "n", "room"), "mix-edge")  # edge: a row a source
    fitted = _edge_units(fitted, seed)

    quota = {r.s: r.n for r in blocks.groupBy("s").agg(F.sum("passes").alias("n")).collect()}
    if shards is None:
        shards = max(SHARDS, min(sum(r.n for r in known) // SHARD_WORDS, sum(quota.values()) // DRAWS))
    ends = np.cumsum(split_quotas([quota.get(i, 0) for i in range(len(plan))], shards, seed), axis=0).T if plan else []
    ends = spark.createDataFrame([(i, [int(x) for x in e]) for i, e in enumerate(ends)], "s int, ends array<long>")
    draws = blocks.where("passes > 0").select("s", "block", "room", "whole", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("pass"))
    turn = F.row_number().over(Window.partitionBy("s").orderBy(F.xxhash64("block", "pass", F.lit(seed)), "block", "pass"))
    draws = draws.withColumn("turn", turn).join(F.broadcast(ends), "s")
    shard = F.size(F.filter("ends", lambda e: e < F.col("turn")))
    draws = draws.withColumn("draw", F.struct(F.col("pass").cast("int").alias("pass"), shard.cast("int").alias("shard"), (F.col("room").isNotNull() & (F.col("pass") == F.col("whole"))).alias("part")))
    draws = written(draws.groupBy("s", "block").agg(F.sort_array(F.collect_list("draw")).alias("draws")), "mix-draws")
    fitted = written(fitted.withColumn("fits", F.lit(True)), "mix-fitted")
    out = dealt(rows).join(sized_hint(draws), ["s", "block"], "left")
    fitted = sized_hint(fitted.withColumnRenamed("size", "size_"))
    out = out.join(fitted, ["s", "place", "size_"], "left")
    taken = F.filter(F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int,part:boolean>>")), lambda d: ~d["part"] | F.coalesce(F.col("fits"), F.lit(False)))
    out = out.withColumn("placed", F.transform(taken, lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"))))
    return out.drop("s", "block", "draws", "fits", "whole", "room", "blocks")


def sized(docs: DataFrame, text_col: str, source_col: str, id_col: str, row_col: str | None = None) -> list[Column]:
    """The columns that placements takes; row_col: what tells rows of one id and text apart, see _numbered."""
    row = F.col(row_col) if row_col else F.lit(0)
    return [F.col(id_col).alias("id_"), F.xxhash64(F.col(text_col)).alias("text_"), row.cast("long").alias("row_"), F.col(source_col).cast("string").alias("source_"), word_count(F.col(text_col)).alias("size_")]


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixed rows: every row of docs as often as it is taken, with mix_shard and mix_order (its place in the shard)."""
    row = "whole_"
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(source_col).alias("s"), F.struct(*[F.col(c) for c in docs.columns]).alias(row))
    own = _numbered(own, "i", "t")
    meta = written(own.select(*sized(own, "t", "s", "i", "row_")), "mix-meta")
    rows = own.select(*sized(own, "t", "s", "i", "row_"), row)
    out = placements(rows, shards, seed, meta=meta).select(row, "place", F.explode("placed").alias("d_"))
    order = F.xxhash64("place", "d_.pass", F.lit(seed + 1))
    return out.select(*[F.col(row)[c].alias(c) for c in docs.columns], F.col("d_.shard").alias(free_name(docs, "mix_shard")), order.alias(free_name(docs, "mix_order")))


def write_shards(mixed: DataFrame, path: str, shards: int | None = None) -> None:
    """One folder per shard, rows in the shard's shuffled order."""
    rows = mixed.repartition(shards, "mix_shard") if shards else mixed.repartition("mix_shard")
    rows.sortWithinPartitions("mix_shard", "mix_order").write.partitionBy("mix_shard").parquet(path)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _numbered(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id", "text")
    meta = written(docs.select(*sized(docs, "text", "source", "doc_id", "row_")), "mix-meta")
    out = placements(meta, meta=meta)
    shards = F.array_join(F.sort_array(F.transform("placed", lambda d: d["shard"])), ",")
    return out.select(F.col("id_").alias("doc_id"), F.col("size_").alias("size"), "source_size", "target", (F.col("size_") * F.size("placed")).alias("taken"), shards.alias("shards"))
