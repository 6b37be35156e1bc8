"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned: every segment (some thousand neighbouring documents) holds for each
test term the ascending positions of its occurrences, in one coordinate that runs through the segment's
documents with a free place between two of them. Segments are rows of a written table. A search reads them, and for each test window intersects the
offset-adjusted position lists, starting from the corpus' rarest term; what is left after all the terms are the
exact phrases. A proximity match is the item's NEAR_TERMS rarest terms, in any order, within NEAR_SPAN
words of one document. No term's list is gathered from different segments, so frequent words and hot documents make no hot task.

Test sets are used in blocks of at most ITEM_CHARS characters; a larger set takes several blocks, each against all rows.

Defined results: null and empty texts have no words and no hits; items without words match nothing; items with
fewer words than the window are one window; repeated items count once; a null item id is written as 'null'; repeated rows
are each searched; empty tables give no matches; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm.shared import ALNUM_TABLE, free_name, released, sized_hint, table, written

WINDOW = 10
NEAR_TERMS = 5
NEAR_SPAN = 20
SEGMENT_WORDS = 1_000_000
ITEM_CHARS = 16_000_000

SEGMENT = "segment long, ids array<long>, keys array<long>, starts binary, lengths binary, terms binary, counts binary, positions binary"
MATCH = "segment long, doc int, item string, kind string, spans array<struct<first:int,last:int>>"


def words(raw: bytes | None) -> list[bytes]:
    """The words of a UTF-8 text: runs of letters and digits, where every character beyond ASCII is a letter."""
    return raw.translate(ALNUM_TABLE).split() if raw else []


def _packed(gaps: np.ndarray) -> bytes:
    """Position gaps as 16-bit numbers; 0xFFFF says that the next two hold a larger gap."""
    large = gaps >= 0xFFFF
    if not large.any():
        return gaps.astype("<u2").tobytes()
    out = np.empty((len(gaps), 3), "<u2")
    out[:, 0] = np.where(large, 0xFFFF, gaps & 0xFFFF)
    out[:, 1], out[:, 2] = gaps & 0xFFFF, gaps >> 16
    return out[np.stack([np.ones_like(large), large, large], axis=1)].tobytes()


def _unpacked(data: bytes, counts: np.ndarray) -> list[np.ndarray]:
    """Each term's positions."""
    raw = np.frombuffer(data, "<u2").astype(np.int64)
    marks = np.flatnonzero(raw == 0xFFFF)
    if len(marks):  # a mark inside a large gap's own number is no mark
        real, last = [], -3
        for m in marks:
            if m > last + 2:
                real.append(m)
                last = m
        real = np.asarray(real)
        raw[real] = raw[real + 1] | raw[real + 2] << 16
        raw = np.delete(raw, np.concatenate([real + 1, real + 2]))
    ends = np.cumsum(counts)
    return [np.cumsum(x) for x in np.split(raw, ends[:-1])]


def _segment(key: int, ids: list, keys: list, terms: list[np.ndarray], lengths: list[int]) -> dict:
    starts = np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64) + 1)])[:-1]
    term = np.concatenate(terms) if terms else np.empty(0, np.int32)
    place = np.concatenate([np.arange(len(t)) + s for t, s in zip(terms, starts, strict=True)]) if terms else np.empty(0, np.int64)
    known = term >= 0
    term, place = term[known], place[known]
    order = np.argsort(term.astype(np.uint16) if len(term) and term.max() < 65536 else term, kind="stable")
    term, place = term[order], place[order].astype(np.int64)
    distinct, first, counts = np.unique(term, return_index=True, return_counts=True)
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    return {"segment": key, "ids": ids, "keys": keys, "starts": starts.astype("<i8").tobytes(), "lengths": np.asarray(lengths, "<i4").tobytes(), "terms": distinct.astype("<i4").tobytes(), "counts": counts.astype("<i4").tobytes(), "positions": _packed(gaps)}


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("segment", pa.int64()), ("ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("starts", "lengths", "terms", "counts", "positions"))]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def _text_key(text_col: str) -> Column:
    """What tells rows that share an id or have none apart; equal texts are hit alike."""
    return F.xxhash64(F.col(text_col).cast("string"))


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The index segments of docs, written. vocabulary numbers the terms that are indexed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key = shared.value.get, TaskContext.get().partitionId() << 32
        ids, keys, terms, lengths, total = [], [], [], [], 0
        for batch in batches:
            for id_, same, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                found = words(raw.as_py())
                ids.append(id_)
                keys.append(same)
                lengths.append(len(found))
                terms.append(np.fromiter(map(number, found, repeat(-1)), np.int32, len(found)))
                total += len(found) + 1
                if total >= SEGMENT_WORDS:
                    yield _arrow([_segment(key, ids, keys, terms, lengths)])
                    key, ids, keys, terms, lengths, total = key + 1, [], [], [], [], 0
        if ids:
            yield _arrow([_segment(key, ids, keys, terms, lengths)])
        released()

    rows = docs.select(F.col(id_col).cast("long"), _text_key(text_col), F.col(text_col).cast("string"))
    index = written(rows.mapInArrow(segments, SEGMENT), "decontamination-index")
    shared.destroy()
    return index


def term_counts(index: DataFrame) -> dict[int, int]:
    """Occurrences of each indexed term in all documents; as many rows as the vocabulary has."""

    def counted(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t, n in zip(np.frombuffer(terms, "<i4").tolist(), np.frombuffer(counts, "<i4").tolist(), strict=True):
                    total[t] = total.get(t, 0) + n
        yield pa.RecordBatch.from_pydict({"term": pa.array(total.keys(), pa.int32()), "n": pa.array(total.values(), pa.int64())})

    rows = index.select("terms", "counts").mapInArrow(counted, "term int, n long")
    return {r.term: r.n for r in rows.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _merged(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Ascending starts of spans of width words as (first, last) of their unions."""
    cuts = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.concatenate([[0], cuts + 1])].tolist(), (starts[np.concatenate([cuts, [len(starts) - 1]])] + width - 1).tolist(), strict=True))


def _windows(term: np.ndarray, rank: np.ndarray, firsts: np.ndarray, width: int, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, offsets) of the windows at firsts whose words are all there, each window's rarest first; there: a segment's terms, ascending."""
    absent = np.cumsum(np.concatenate([[0], ~np.isin(term, there)]))
    firsts = firsts[absent[firsts + width] == absent[firsts]]
    offsets = np.argsort(np.lib.stride_tricks.sliding_window_view(rank, width)[firsts], axis=1)
    return term[firsts[:, None] + offsets], offsets


def _phrases(lists: dict[int, np.ndarray], window: list[int], offsets: list[int]) -> np.ndarray:
    """Starts of a window, given its terms and their offsets, rarest first."""
    got = lists[window[0]] - offsets[0]
    for t, o in zip(window[1:], offsets[1:], strict=True):
        have = lists[t]
        want = got + o
        at = np.searchsorted(have, want)
        got = got[have[np.minimum(at, len(have) - 1)] == want]
        if not len(got):
            break
    return got


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How far each of a is from the nearest of b."""
    at = np.searchsorted(b, a)
    return np.minimum(np.abs(b[np.minimum(at, len(b) - 1)] - a), np.abs(b[np.maximum(at - 1, 0)] - a))


def _near(lists: dict[int, np.ndarray], rare: list[int], span: int, starts: np.ndarray) -> np.ndarray:
    """Places of rare[0] that lie with each other term in one stretch of span words of a document; starts: the documents'."""
    have = [lists.get(t) for t in rare]
    if len(have) < 2 or any(h is None for h in have):
        return np.empty(0, np.int64)
    got = have[0]
    for h in have[1:]:
        got = got[_apart(got, h) < span]
        if not len(got):
            return got
    have = [h[_apart(h, got) < span] for h in have]
    # each place as a stretch's last: the terms' last places up to it, of which the lowest tells how long the stretch is
    ends = np.sort(np.concatenate(have))
    lows = ends
    for h in have:
        at = np.searchsorted(h, ends, side="right") - 1
        lows = np.minimum(lows, np.where(at < 0, -span, h[at]))
    doc = lambda x: np.searchsorted(starts, x, side="right")
    ends = ends[(ends - lows < span) & (doc(lows) == doc(ends))]
    if not len(ends):
        return got[:0]
    after = ends[np.minimum(np.searchsorted(ends, got), len(ends) - 1)]
    return got[(after >= got) & (after - got < span) & (doc(after) == doc(got))]


def search(index: DataFrame, items: list[tuple[str, list[int]]], counts: dict[int, int], window: int = WINDOW) -> DataFrame:
    """Matches (segment, doc, item, kind, spans) of items (id, term numbers); doc counts a segment's documents from 0."""
    plans = []
    for id_, term in items:
        order = sorted(range(len(term)), key=lambda o: (counts.get(term[o], 0), o))
        rare = list(dict.fromkeys(term[o] for o in order))[:NEAR_TERMS]
        rank = np.empty(len(term), np.int32)
        rank[order] = np.arange(len(term), dtype=np.int32)
        # a window with a word that no document has occurs nowhere, the item's other windows may; such a word is among the rarest
        absent = np.cumsum([0, *(t not in counts for t in term)])
        width = min(window, len(term))
        firsts = np.flatnonzero(absent[width:] == absent[: len(absent) - width]).astype(np.int32)
        if term and len(firsts):
            plans.append((id_, np.array(term, np.int32), rank, [] if absent[-1] else rare, firsts))
    shared = index.sparkSession.sparkContext.broadcast(plans)

    def matches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                starts = np.frombuffer(row["starts"], "<i8")
                there = np.frombuffer(row["terms"], "<i4")
                lists = dict(zip(there.tolist(), _unpacked(row["positions"], np.frombuffer(row["counts"], "<i4")), strict=True)) if len(there) else {}
                out: list[dict] = []

                def put(id_: str, kind: str, places: np.ndarray, width: int, row=row, starts=starts, out=out) -> None:
                    doc = np.searchsorted(starts, places, side="right") - 1
                    cuts = np.flatnonzero(np.diff(doc)) + 1
                    for d, p in zip(doc[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
                        spans = [{"first": a, "last": b} for a, b in _merged(p - starts[d], width)]
                        out.append({"segment": row["segment"], "doc": d, "item": id_, "kind": kind, "spans": spans})

                for id_, term, rank, rare, firsts in shared.value:
                    width = min(window, len(term))
                    hits = [_phrases(lists, *x) for x in zip(*(a.tolist() for a in _windows(term, rank, firsts, width, there)), strict=True)]
                    if hits and len(places := np.unique(np.concatenate(hits))):
                        put(id_, "exact", places, width)
                    if len(places := _near(lists, rare, NEAR_SPAN, starts)):
                        put(id_, "near", places, 1)
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_MATCH_ARROW)
        released()

    return index.select("segment", "starts", "terms", "counts", "positions").mapInArrow(matches, MATCH)


_MATCH_ARROW = pa.schema([("segment", pa.int64()), ("doc", pa.int32()), ("item", pa.string()), ("kind", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])


def _directory(index: DataFrame) -> DataFrame:
    """(segment, doc, id, key, n_words) of every indexed row."""

    def rows(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["ids"])
                yield pa.RecordBatch.from_pydict({"segment": pa.array([r["segment"]] * n, pa.int64()), "doc": pa.array(range(n), pa.int32()), "id": pa.array(r["ids"], pa.int64()), "key": pa.array(r["keys"], pa.int64()), "n_words": pa.array(np.frombuffer(r["lengths"], "<i4").astype(np.int64))})

    return index.select("segment", "ids", "keys", "lengths").mapInArrow(rows, "segment long, doc int, id long, key long, n_words long")


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(directory, matches): one row (segment, doc, id, key, n_words) per row of docs, and all matches, written."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).where("length(text) > 0")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // ITEM_CHARS) or 1
    matches = directory = None
    docs = docs.select(id_col, text_col)
    if blocks > 1:  # the same files for each block, so that all number the rows alike
        docs = written(docs, "decontamination-docs")
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).distinct().collect()
        vocabulary: dict[bytes, int] = {}
        known = [(r.item, [vocabulary.setdefault(w, len(vocabulary)) for w in words(r.text.encode())]) for r in some]
        index = build_index(docs, vocabulary, text_col, id_col)
        got = written(search(index, [x for x in known if x[1]], term_counts(index), window), "decontamination-matches")
        directory = _directory(index) if directory is None else directory
        matches = got if matches is None else matches.union(got)
    return directory, matches


def hits(directory: DataFrame, matches: DataFrame) -> DataFrame:
    """Per row of the directory: n_words, n_hit, items (of exact matches, sorted as strings), near_items."""
    # of all the spans the words they cover together: sorted by start, each adds what lies beyond those before it
    step = "aggregate(array_sort(flatten(collect_list(case when kind = 'exact' then spans end))), named_struct('n', 0L, 'upto', -1), (s, x) -> named_struct('n', s.n + cast(greatest(0, x.last - greatest(s.upto, x.first - 1)) as bigint), 'upto', greatest(s.upto, x.last)), s -> s.n)"
    each = matches.groupBy("segment", "doc").agg(F.expr(step).alias("n_hit"), F.expr("array_sort(collect_set(case when kind = 'exact' then item end))").alias("items"), F.expr("array_sort(collect_set(case when kind = 'near' then item end))").alias("near_items"))
    empty = F.array().cast("array<string>")
    return directory.join(each, ["segment", "doc"], "left").select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", empty).alias("items"), F.coalesce("near_items", empty).alias("near_items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs in which no test window occurs. They are told by id and text, so of rows that share an id or have none only those that are hit go."""
    directory, matches = find(docs, benchmark, text_col, id_col)
    hit = sized_hint(written(matches.where("kind = 'exact'").select("segment", "doc").distinct(), "decontamination-hit"))
    bad, key = free_name(docs, "bad_"), free_name(docs, "bad_key_")
    found = directory.join(hit, ["segment", "doc"], "left_semi").select(F.col("id").alias(bad), F.col("key").alias(key)).distinct()
    found = sized_hint(written(found, "decontamination-bad"))
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found[bad]) & (_text_key(text_col) == found[key]), "left_anti")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(*find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
        F.sha2(F.array_join("near_items", ","), 256).alias("near_sha256"),
    )


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_SQL_WORDS} AS w FROM benchmark),
n AS (SELECT item, w, least({WINDOW}, len(w)) AS width FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, width, array_to_string(w[s:s + width - 1], ' ') AS win FROM (SELECT item, w, width, unnest(range(1, len(w) - width + 2)) AS s FROM n)),
widths AS (SELECT DISTINCT width FROM win),
places AS (SELECT doc_id, width, s, array_to_string(w[s:s + width - 1], ' ') AS win FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS s FROM d, widths WHERE len(w) >= width)),
hit AS (SELECT doc_id, item, s, a.width FROM places a JOIN win USING (width, win)),
n_hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
posting AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
freq AS (SELECT t, count(*) AS n FROM posting GROUP BY t),
term AS (SELECT item, w, t, min(o) AS o FROM (SELECT item, w, unnest(w) AS t, generate_subscripts(w, 1) AS o FROM n) GROUP BY item, w, t),
rare AS (SELECT item, w, t, coalesce(freq.n, 0) AS n FROM term LEFT JOIN freq USING (t) QUALIFY row_number() OVER (PARTITION BY item, w ORDER BY coalesce(freq.n, 0), o) <= {NEAR_TERMS}),
asked AS (SELECT item, w, count(*) AS k FROM rare GROUP BY item, w HAVING count(*) > 1 AND min(n) > 0),
together AS (SELECT doc_id, item, k, count(DISTINCT t) OVER (PARTITION BY doc_id, item, w ORDER BY p RANGE BETWEEN {NEAR_SPAN - 1} PRECEDING AND CURRENT ROW) AS found
  FROM posting JOIN rare USING (t) JOIN asked USING (item, w)),
near AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item FROM together WHERE found = k) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.l, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated,
  CAST(coalesce(near.n, 0) AS BIGINT) AS n_near, sha256(coalesce(near.l, '')) AS near_sha256
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
