"""Document fingerprints by Order MinHash, which follow edit distance.

A text's K-character grams are numbered by occurrence, so a repeated gram counts as often as it stands there.
Each of SKETCHES hash functions picks the PICKED numbered grams of least hash, puts them back into text
order and hashes that tuple. Two texts agree in a place of the signature if the same grams were picked in the same
order; the share of equal places is their likeness.

Grams are hashed by doubling (one, two, four, eight characters ...) with numpy, numbered by one sort of
(hash, position), and the hash functions are applied to stretches of grams that stay near the processor.

Defined results: null and empty texts have the fingerprint of no grams; a text shorter than K is one gram; equal texts have
equal fingerprints, so two empty texts are alike; rows of one id are neighbours in the order of a hash of
their texts, which spreads many of them over several tasks, and then of their texts; null ids come first; whole texts are read at any length; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm.shared import partitions, spread_bounds, spread_number, table

K = 12
SKETCHES = 64
PICKED = 2
_CHUNK = 16384
_LEAST = np.iinfo(np.int64).min


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the result depends on every bit of x."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)


_RNG = np.random.Generator(np.random.Philox(key=12))
_XOR = _RNG.integers(0, 1 << 32, (SKETCHES, 1), np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, (SKETCHES, 1), np.uint32) | np.uint32(1)
_ROWS = np.arange(SKETCHES)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def _grams(codes: np.ndarray) -> np.ndarray:
    """The hashes of all K-grams; of a shorter text one hash of the whole."""
    base = 0x9E3779B97F4A7C15
    if not len(codes):
        return np.empty(0, np.uint64)
    if len(codes) < K:
        total = len(codes)
        for c in codes.tolist():
            total = (total * base + c + 1) % (1 << 64)
        return np.array([total], np.uint64)
    part = codes.astype(np.uint64) + np.uint64(1)
    total, done, width, rest = None, 0, 1, K
    while rest:
        if rest & 1:
            total = part[: len(codes) - width + 1] if total is None else total[: len(codes) - done - width + 1] * np.uint64(pow(base, width, 1 << 64)) + part[done : len(codes) - width + 1]
            done += width
        rest >>= 1
        if rest:
            part = part[:-width] * np.uint64(pow(base, width, 1 << 64)) + part[width:]
            width *= 2
    return total


def signature(codes: np.ndarray) -> np.ndarray:
    """The signature of a text's code points: SKETCHES 16-bit numbers."""
    grams = _mix(_grams(codes))
    n = len(grams)
    if not n:
        return np.zeros(SKETCHES, np.uint16)
    shift = np.uint64(max(20, n.bit_length()))
    packed = np.sort(grams >> shift << shift | np.arange(n, dtype=np.uint64))
    where = (packed & (np.uint64(1) << shift) - np.uint64(1)).astype(np.int64)
    value = packed >> shift
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    occurrence = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    value = _mix(value * np.uint64(0x2545F4914F6CDD1D) + occurrence.astype(np.uint64))
    small = (value >> np.uint64(32)).astype(np.uint32)
    least, at = [], []
    for lo in range(0, n, _CHUNK):
        y = small[lo : lo + _CHUNK] ^ _XOR  # the values are mixed already, so one odd factor orders them anew
        y *= _TIMES
        for _ in range(min(PICKED, y.shape[1])):
            i = y.argmin(axis=1)
            least.append(y[_ROWS, i])
            at.append(i + lo)
            y[_ROWS, i] = 0xFFFFFFFF
    picked = np.stack(at, axis=1)
    if len(at) > PICKED:
        order = np.argsort(np.stack(least, axis=1), axis=1, kind="stable")[:, :PICKED]
        picked = np.take_along_axis(picked, order, axis=1)
    picked = np.take_along_axis(picked, np.argsort(where[picked], axis=1), axis=1)
    total = np.full(SKETCHES, picked.shape[1], np.uint64)
    for j in range(picked.shape[1]):
        total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + value[picked[:, j]])
    return (total >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def neighbours(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(bucket, extra, key, tie, id, text), dealt by ranges of id and, within one id, of a hash of the text, and sorted: behind each range's
    rows stands, as extra, the row that follows them (after the last range the first row). Texts are shuffled once."""
    n = partitions(docs.sparkSession)
    text, id_ = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(id_, F.lit(_LEAST)).alias("key"), F.crc32(F.coalesce(text, F.lit(""))).alias("tie"), id_.alias("id"), text.alias("text"))
    bucket = spread_number(F.col("key"), F.col("tie"), spread_bounds(rows, "key", n))
    found = rows.groupBy(bucket.alias("b")).agg(F.min(F.struct("key", "tie")).alias("k")).collect()  # a row for each range
    first = sorted((r.b, r.k.key, r.k.tie) for r in found)
    place = lambda key, tie: F.struct(F.lit(key).cast("long").alias("key"), F.lit(tie).cast("long").alias("tie"))
    marks = [x for i, (_, key, tie) in enumerate(first) for x in (place(key, tie), F.lit(first[i - 1][0]))]
    follows = F.element_at(F.create_map(*marks), F.struct("key", "tie")) if marks else F.lit(None).cast("int")
    rows = rows.withColumn("own", bucket)
    rows = rows.select("key", "tie", "id", "text", F.posexplode(F.array_compact(F.array("own", follows))).alias("extra", "bucket"))
    return rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "extra", "key", "tie", "text")


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half (rounded down) replaced by as much of the next one's start."""

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, closed = None, None
        for batch in batches:
            out = []
            for bucket, extra, id_, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket == closed:
                    continue  # further rows with the first id of the next range
                text = text or ""
                codes = code_points(text)
                now = (id_, text, codes, signature(codes))
                if held is not None:
                    out.append(_compared(held, now))
                held, closed = (None, bucket) if extra else (now, closed)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ROW)

    rows = neighbours(docs, text_col, id_col).select("bucket", "extra", "id", "text")
    return rows.mapInArrow(compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(doc: tuple, following: tuple) -> dict:
    id_, text, codes, sketch = doc
    half = len(codes) // 2
    edited = text[: len(codes) - half] + following[1][:half]
    changed = signature(np.concatenate([codes[: len(codes) - half], following[2][:half]]))
    return {
        "doc_id": id_,
        "n_chars": len(codes),
        "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        "fingerprint": sketch.astype(">u2").tobytes().hex(),
        "edited_fingerprint": changed.astype(">u2").tobytes().hex(),
        "near_edited": likeness(sketch, changed),
        "near_next": likeness(sketch, following[3]),
    }


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
