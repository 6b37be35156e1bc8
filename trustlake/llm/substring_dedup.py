"""Exact substring deduplication: windows of WINDOW words that also stand earlier are removed.

1. A task hashes every window of its documents with Rabin-Karp: a word is the polynomial of its bytes, a window the polynomial of
   its words' mixed hashes, both from prefix sums modulo 2^64, so a window costs the same however long it is. Two such polynomials
   over differently mixed words give a window 72 bits and the number of its bucket.
2. Documents are taken in chunks. Of the windows that a chunk has several times the earliest stays and the others are marked at once, so
   a passage that a third of all documents share reaches its bucket once a chunk. What is left is packed by bucket, and Spark
   groups the buckets: equal windows meet there, the earliest by (doc_id, start) stays and the others are marked.
3. Marks go back to their chunk, where the words of marked windows merge into maximal intervals; these join the documents.

Two different windows are taken for equal if all of their bits agree: with n windows and b buckets some n^2 / (2^73 b) pairs, which is 4 in 10^7 for
a billion words in 256 buckets.

Defined results: null texts have no words; texts of fewer words than a window lose nothing; a window that overlaps an equal earlier one is removed like any
other; rows that share an id (or have none: these come before all others) are compared by start alone, so equal rows of one id lose
nothing to each other; very long texts are read whole and make a larger chunk; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm.shared import BROADCAST_ROWS, batches_of, free_name, partitions, released, slices, table, written

WINDOW = 20
CHUNK_BYTES = 4 << 20
BUCKET_WINDOWS = 2_000_000
#: Intervals of at most this many numbers in at most BROADCAST_ROWS rows are broadcast (16 MB); beyond, documents are shuffled to them.
BROADCAST_SPANS = 2_000_000
_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_NO_ID = -(1 << 63)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

PACKED = "bucket int, chunk long, settled boolean, hashes binary, more binary, places binary, doc_ids binary, doc_keys binary, doc_firsts binary"
SPANS = "doc_id long, doc_key long, spans array<struct<first:int,last:int>>"


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(_SLICE, size).bit_length())


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, polynomial hash) of each word of bytes that end in a space."""
    firsts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + _SLICE, len(data))
        while not (cut := np.flatnonzero(_SPACE[data[at:end]])).size:  # a word that is longer than a slice
            end = min(2 * end - at, len(data))
        end = at + int(cut[-1]) + 1
        part = data[at:end]
        space = _SPACE[part]
        before = np.concatenate([[True], space[:-1]])
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        power, inverse = _tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        firsts.append(starts + at)
        hashes.append((sums[ends] - sums[starts]) * inverse[starts])
        at = end
    if not firsts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(firsts), np.concatenate(hashes)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The polynomial hash of each stretch of width words, by prefix sums over pieces that overlap by width - 1."""
    out = []
    for at in range(0, len(words) - width + 1, _SLICE // 4):
        part = words[at : at + _SLICE // 4 + width - 1]
        power, inverse = _tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        out.append((sums[width:] - sums[:-width]) * inverse[: len(part) - width + 1])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _later(hashes: np.ndarray, more: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which windows have an equal one with a smaller (id, start)."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    several = np.zeros(len(hashes), bool)
    several[1:] = same
    several[:-1] |= same
    out = np.zeros(len(hashes), bool)
    some = order[several]
    if not len(some):
        return out
    some = some[np.lexsort((starts[some], ids[some], more[some], hashes[some]))]
    fresh = np.concatenate([[True], (hashes[some[1:]] != hashes[some[:-1]]) | (more[some[1:]] != more[some[:-1]])])
    first = some[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    out[some] = (ids[some] != ids[first]) | (starts[some] != starts[first])
    return out


def _packed(chunk: int, bucket: np.ndarray, settled: bool, hashes: np.ndarray, more: np.ndarray, place: np.ndarray, doc: np.ndarray, ids: np.ndarray, keys: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
    """One row a bucket: its windows in their order, and the documents that these lie in."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max() < 65536 else bucket, kind="stable")
    bucket = bucket[order]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    rows: dict[str, list] = {c: [] for c in ("bucket", "hashes", "more", "places", "doc_ids", "doc_keys", "doc_firsts")}
    for a, b in zip(cuts, cuts[1:], strict=False):
        mine = order[a:b]
        docs = np.unique(doc[mine])
        rows["bucket"].append(int(bucket[a]))
        rows["hashes"].append(b"" if settled else hashes[mine].tobytes())
        rows["more"].append(b"" if settled else more[mine].tobytes())
        rows["places"].append(_gaps(place[mine]))
        rows["doc_ids"].append(ids[docs].tobytes())
        rows["doc_keys"].append(keys[docs].tobytes() if keys[docs].any() else b"")
        rows["doc_firsts"].append(firsts[docs].astype("<u4").tobytes())
    n = len(cuts) - 1
    columns = [pa.array(rows["bucket"], pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array([settled] * n), *(pa.array(rows[c], pa.binary()) for c in list(rows)[1:])]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "settled", *list(rows)[1:]])


def _gaps(places: np.ndarray) -> bytes:
    """Ascending places as gaps in bytes; 255 stands before a gap of four bytes."""
    gaps = np.diff(places, prepend=0)
    if not (large := gaps >= 255).any():
        return gaps.astype(np.uint8).tobytes()
    out = np.empty((len(gaps), 5), np.uint8)
    out[:, 0] = np.where(large, 255, gaps)
    out[:, 1:] = gaps.astype("<u4").view(np.uint8).reshape(-1, 4)
    keep = np.repeat(large[:, None], 5, axis=1)
    keep[:, 0] = True
    return out[keep].tobytes()


def _places(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero(raw == 255).tolist()
    real, last = [], -5
    for m in marks:  # a 255 inside a large gap's own bytes is no mark
        if m > last + 4:
            real.append(m)
            last = m
    if not real:
        return np.cumsum(raw, dtype=np.int64)
    at = np.asarray(real)
    gaps = raw.astype(np.int64)
    gaps[at] = sum(gaps[at + k] << 8 * (k - 1) for k in range(1, 5))
    return np.cumsum(np.delete(gaps, (at[:, None] + np.arange(1, 5)).ravel()))


def _chunk(key: int, docs: list[tuple], width: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The windows of some documents (id, key, bytes): those that stand earlier in the chunk as settled, the rest to be compared."""
    docs.sort(key=lambda d: d[0])
    ids, keys = (np.array([d[i] for d in docs], np.int64) for i in (0, 1))
    firsts, hashes = word_hashes(np.frombuffer(b" ".join([d[2] for d in docs]) + b" ", np.uint8))
    offsets = np.cumsum([0, *(len(d[2]) + 1 for d in docs)])[:-1]
    first_word = np.searchsorted(firsts, offsets)
    if len(firsts) < width:
        return
    doc = np.searchsorted(offsets, firsts, side="right") - 1
    place = np.flatnonzero(doc[width - 1 :] == doc[: len(doc) - width + 1])
    if not len(place):
        return
    doc = doc[place]
    one, two = (window_hashes(_mixed(hashes, salt), width)[place] for salt in (_BASE, 0xD1B54A32D192ED03))
    two = _mixed(two, 0)
    more, bucket = (two & np.uint64(0xFF)).astype(np.uint8), ((two >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    late = _later(one, more, ids[doc], place - first_word[doc])
    for settled, some in ((True, np.flatnonzero(late)), (False, np.flatnonzero(~late))):
        if len(some):
            into = np.full(len(some), key % buckets) if settled else bucket[some]
            yield _packed(key, into, settled, one[some], more[some], place[some], doc[some], ids, keys, first_word)


def _judged(group: pa.Table) -> pa.Table:
    """Of a bucket's rows those with marked windows, and only these in them."""
    rows = group.to_pylist()
    kept = [r for r in rows if r["settled"]]
    rows = [r for r in rows if not r["settled"]]
    if rows:
        hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        more = np.concatenate([np.frombuffer(r["more"], np.uint8) for r in rows])
        places = [_places(r["places"]) for r in rows]
        firsts = [np.frombuffer(r["doc_firsts"], "<u4").astype(np.int64) for r in rows]
        docs = [np.searchsorted(f, p, side="right") - 1 for f, p in zip(firsts, places, strict=True)]
        ids = np.concatenate([np.frombuffer(r["doc_ids"], np.int64)[d] for r, d in zip(rows, docs, strict=True)])
        starts = np.concatenate([p - f[d] for p, f, d in zip(places, firsts, docs, strict=True)])
        late = _later(hashes, more, ids, starts)
        at = 0
        for r, p in zip(rows, places, strict=True):
            mine = late[at : at + len(p)]
            at += len(p)
            if mine.any():
                kept.append(r | {"places": _gaps(p[mine])})
    names = ["chunk", "places", "doc_ids", "doc_keys", "doc_firsts"]
    kinds = [pa.int64(), *[pa.binary()] * 4]
    return pa.Table.from_arrays([pa.array([r[n] for r in kept], k) for n, k in zip(names, kinds, strict=True)], names)


def _merged(width: int):
    def merged(group: pa.Table) -> pa.Table:
        """The intervals of a chunk's documents from all its marked windows."""
        rows = group.to_pylist()
        known: dict[int, tuple[int, int]] = {}
        for r in rows:
            ids = np.frombuffer(r["doc_ids"], np.int64).tolist()
            keys = np.frombuffer(r["doc_keys"], np.int64).tolist() or [0] * len(ids)
            known.update(zip(np.frombuffer(r["doc_firsts"], "<u4").tolist(), zip(ids, keys, strict=True), strict=True))
        first_words = np.array(sorted(known), np.int64)
        places = np.sort(np.concatenate([_places(r["places"]) for r in rows]))
        doc = np.searchsorted(first_words, places, side="right") - 1
        # windows that overlap or touch are one interval
        fresh = np.concatenate([[True], (np.diff(places) > width) | (np.diff(doc) > 0)])
        begins, ends = np.flatnonzero(fresh), np.concatenate([np.flatnonzero(fresh)[1:], [len(places)]]) - 1
        of = doc[begins]
        base = first_words[of]
        spans = pa.StructArray.from_arrays([pa.array(places[begins] - base, pa.int32()), pa.array(places[ends] - base + width - 1, pa.int32())], ["first", "last"])
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
        docs = [known[f] for f in first_words[of[cuts[:-1]]].tolist()]
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), spans)
        return pa.Table.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([k for _, k in docs], pa.int64()), lists], ["doc_id", "doc_key", "spans"])

    return merged


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(id, key, text) of docs: null ids as the lowest number; key tells rows of one id apart by their texts, and is 0 where an id is one row's."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    again = written(rows.groupBy("id").count().where(f"count > 1 or id = {_NO_ID}").select(F.col("id").alias("again")), "substring-ids")
    few = again.limit(BROADCAST_ROWS + 1).count()
    if not few:
        return rows.select("id", F.lit(0).cast("long").alias("key"), "text")
    rows = rows.join(F.broadcast(again) if few <= BROADCAST_ROWS else again, F.col("id") == F.col("again"), "left")
    return rows.select("id", F.when(F.col("again").isNotNull(), F.xxhash64("text")).otherwise(0).alias("key"), "text")


def repeated_spans(keyed: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, doc_key, spans), written: the maximal intervals of words, counted from 0, that repeated windows cover. keyed: (id, key, text)."""
    size = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(2 * partitions(keyed.sparkSession), -(-size // (6 * BUCKET_WINDOWS)))  # some six characters a word

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, total = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for some in slices(batch):
                for doc in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), some.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    if doc[2]:
                        docs.append(doc)
                        total += len(doc[2])
                    if total >= CHUNK_BYTES:
                        yield from _chunk(key, docs, width, buckets)
                        key, docs, total = key + 1, [], 0
        if docs:
            yield from _chunk(key, docs, width, buckets)
        _powers.cache_clear()
        released()

    rows = keyed.mapInArrow(packed, PACKED)
    marked = rows.groupBy("bucket").applyInArrow(_judged, "chunk long, places binary, doc_ids binary, doc_keys binary, doc_firsts binary")
    spans = marked.groupBy("chunk").applyInArrow(_merged(width), SPANS)
    with batches_of(keyed.sparkSession, 2000):
        return written(spans.dropDuplicates(["doc_id", "doc_key"]), "substring-spans")  # equal rows of one id have equal intervals


def _cut(text: bytes | None, spans: list[dict] | None) -> dict:
    words = text.split() if text else []
    if not spans:
        return {"n_words": len(words), "n_removed": 0, "text": b" ".join(words)}
    kept, at = [], 0
    for s in spans:
        kept += words[at : s["first"]]
        at = s["last"] + 1
    kept += words[at:]
    return {"n_words": len(words), "n_removed": len(words) - len(kept), "text": b" ".join(kept)}


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WINDOW) -> DataFrame:
    """docs with a struct column substring_dedup: n_words, n_removed, text (the kept words with single spaces)."""
    keyed = _keyed(docs, text_col, id_col)
    spans = repeated_spans(keyed, width)
    name, key, id_, cuts = (free_name(docs, c) for c in ("substring_dedup", "doc_key", "span_id", "spans"))
    spans = spans.select(F.col("doc_id").alias(id_), F.col("doc_key").alias("span_key_"), F.col("spans").alias(cuts))
    several = spans.where("span_key_ <> 0").limit(1).count()
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID))
    rows, numbers = spans.agg(F.count("*"), F.sum(F.size(cuts))).first()
    if rows <= BROADCAST_ROWS and (numbers or 0) <= BROADCAST_SPANS:
        spans = F.broadcast(spans)
    on = own == F.col(id_)
    if several:  # an id's only row has key 0, and rows that share one have their texts' hashes
        docs_ = docs.withColumn(key, F.xxhash64(F.col(text_col).cast("string")))
        on &= (F.col("span_key_") == 0) | (F.col("span_key_") == F.col(key))
    else:
        docs_ = docs
    joined = docs_.join(spans, on, "left")

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,text:string>")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for a in range(0, len(texts), 512):
            some = [_cut(t, s) for t, s in zip(texts.slice(a, 512).cast(pa.binary()).to_pylist(), found.slice(a, 512).to_pylist(), strict=True)]
            columns = [pa.array([x["n_words"] for x in some], pa.int64()), pa.array([x["n_removed"] for x in some], pa.int64()), pa.array([x["text"] for x in some], pa.binary()).cast(pa.string())]
            out.append(pa.StructArray.from_arrays(columns, ["n_words", "n_removed", "text"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())]))

    return joined.withColumn(name, cut(F.col(text_col).cast("string"), F.col(cuts))).select(*docs.columns, name)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "substring_dedup.n_words", "substring_dedup.n_removed", F.sha2("substring_dedup.text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, sha256(array_to_string(w[s + 1:s + {WINDOW}], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS s FROM d WHERE len(w) >= {WINDOW})),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, min((doc_id, s)) OVER (PARTITION BY h) AS f FROM win) WHERE (doc_id, s) > f),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS p FROM later),
word AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
