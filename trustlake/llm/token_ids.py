"""Token ids in a binary file: frequency ranks in byte-aligned variable-length coding with separate control bytes.

A file is a Parquet table of blocks; its part files follow one another in ascending document order, so that any
executor can write or read any block. A block holds some hundred thousand ids of neighbouring documents:

- `control`: two bits an id, four ids a byte, lowest bits first: the number of data bytes less one; a document
  begins with a new byte, and bits left over in its last one are 0;
- `data`: the ids' low bytes, little-endian, 1 to 4 an id;
- `doc_ids`, `doc_tokens`: the documents of the block and how many ids each has (a null id is kept);
- `shard`, `block`: its place in the order; `start`: how many ids of the shard stand before it.

What is coded is not the vocabulary's id but its frequency rank in the corpus (0: the most frequent; ties by
id), so frequent ids take one byte. The table of ranks, one row per used id, is written beside the blocks.
Decoding looks the four lengths of each control byte up in a table of 256 rows and gathers the data bytes with numpy.

Defined results: null and empty texts hold the end id alone; repeated rows are written one after another (equal ids ordered
by a hash of their tokens, which also spreads many of them over several tasks, null ids first); very long texts make a large block and are never cut; an empty table makes an
empty file; other columns are not written.
"""

from __future__ import annotations

import string
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlake.llm.shared import batches_of, partitions, released, shared_path, spread_bounds, spread_numbers, table, written

BLOCK_TOKENS = 1 << 18
END_ID = 1
#: Chunks of text whose ids a worker remembers, twice: those before are dropped, which changes no result.
MEMORY = 320_000

_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of one document's unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    return control.tobytes(), data.tobytes()


def encode_many(values: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(control, data) of documents whose values stand one after another, as encode_ids gives them for each."""
    values = np.ascontiguousarray(values, "<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    slots = -(-counts // 4)
    ends = np.cumsum(slots)
    place = np.arange(len(values)) + np.repeat(4 * (ends - slots) - (np.cumsum(counts) - counts), counts)
    padded = np.zeros(4 * int(slots.sum()), np.uint8)
    padded[place] = code
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= code[:, None]]
    upto = np.concatenate([[0], np.cumsum(code, dtype=np.int64) + np.arange(1, len(code) + 1)])[np.concatenate([[0], np.cumsum(counts)])]

    def binary(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat)])

    return binary(control, np.concatenate([[0], ends])), binary(data, upto)


def decode_ids(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The values of a block's documents, one after another; counts: how many each has."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()
    counts = np.asarray(counts, np.int64)
    slots = -(-counts // 4) * 4
    ends = np.cumsum(slots)
    used = np.ones(len(lengths), bool)
    for k in (1, 2, 3):
        used[ends[slots - counts >= k] - k] = False
    lengths = lengths[used]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        if len(more := np.flatnonzero(lengths > k)):
            out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


_TAIL = string.punctuation.replace("'", "")
_KEPT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: Byte-level models write each byte as a visible character: itself, or one from 256 on.
_VISIBLE = {b: (b if b in _KEPT else 256 + sum(x not in _KEPT for x in range(b))) for b in range(256)}


class _Seen(dict):
    """How a byte-level model writes a character."""

    def __missing__(self, char: str) -> str:
        self[char] = out = char.encode().decode("latin-1").translate(_VISIBLE)
        return out


_SEEN = _Seen()


class _Chunks(dict):
    """The ids, as bytes, of stretches of text between spaces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.old: dict[str, bytes] = {}
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer  # their own specifications, without the vocabulary's
        rules = [normalizer.__getstate__(), splitter.__getstate__()] if normalizer and splitter else [b"", b""]
        #: Whether spaces only part words: case is folded, and what stands between words is thrown away.
        self.plain = b"Lowercase" in rules[0] and b"ByteLevel" in rules[1] and b'"behavior":"Removed","invert":true' in rules[1]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMORY:  # the chunks seen since the last time stay for one more round
            self.old = dict(self)
            self.clear()
        out = self.old.get(chunk)
        if out is None:
            stem = chunk.rstrip(_TAIL) if self.plain else ""
            if not stem or not stem[-1].isalpha():
                out = self._whole(chunk)
            elif len(stem) < len(chunk):  # letters and punctuation are never looked up together
                out = self[stem] + self[chunk[len(stem) :]]
            else:
                out = self._word(chunk)
        self[chunk] = out
        return out

    def _word(self, chunk: str) -> bytes:
        plain = chunk.isascii()
        if not plain and max(chunk) >= "\u0300":
            return self._whole(chunk)
        if (low := chunk.lower()) != chunk:  # nothing to compose, so case may be folded first
            return self[low] if plain or max(low) < "\u0300" else self._whole(chunk)
        if not chunk.isalpha():
            return self._whole(chunk)
        # one word: straight to the model
        return array("I", [t.id for t in self.model.tokenize(chunk if plain else "".join(map(_SEEN.__getitem__, chunk)))]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


@cache
def encoder(path: str) -> Callable[[str | None], bytes]:
    """text -> its ids as little-endian unsigned 32-bit integers; one for each tokenizer and task.

    For a tokenizer that throws spaces away before it looks words up, the ids of a text are those of its stretches
    between spaces, one after another; these repeat, so a task remembers them. A text that has a special token's
    marks, and every text of another kind of tokenizer, is encoded as a whole."""
    chunks = _Chunks(path)
    marks = [t.content for t in chunks.tokenizer.get_added_tokens_decoder().values()]
    signs = {m[:1] for m in marks}

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if not chunks.plain or (any(c in text for c in signs) and any(m in text for m in marks)):
            return chunks._whole(text)
        with suppress(UnicodeEncodeError):
            text.encode("latin-1")  # nothing to compose and no letter that grows, so all of the text's case may be folded at once
            text = text.lower()
        return b"".join(map(chunks.__getitem__, text.replace("\n", " ").split(" ")))

    return encode


def tokenize(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """(id long, ids binary) of every row, written: the whole text's ids and end_id, little-endian 32-bit."""
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([encode(t) + end for t in some.column(1).to_pylist()], pa.binary())], ["id", "ids"])
        del encode
        encoder.cache_clear()
        released()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with batches_of(docs.sparkSession, 4000):
        return written(rows.mapInArrow(encoded, "id long, ids binary"), "token-rows")


def ranks(rows: DataFrame) -> np.ndarray:
    """The used ids by falling frequency in all rows, ties by id: as many as the vocabulary has at most."""

    def counted(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            some = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=len(total))
            some[: len(total)] += total
            total = some
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(used), "n": pa.array(total[used])})

    found = rows.select("ids").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    pairs = sorted((-r.n, r.token) for r in found.collect())
    return np.array([t for _, t in pairs], np.uint32)


def write_token_file(docs: DataFrame, path: str, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", end_id: int = END_ID) -> None:
    """Write docs in ascending id order to path/blocks and the table of ranks to path/ranks."""
    spark = docs.sparkSession
    rows = tokenize(docs, tokenizer, text_col, id_col, end_id)
    by_rank = ranks(rows)
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, token long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank_of)

    bounds = spread_bounds(rows, "id", partitions(spark))

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            counts = np.array([len(x) for x in raw], np.int64) // 4
            control, data = encode_many(shared.value[np.frombuffer(b"".join(raw), "<u4")], counts)
            ties = np.array([crc32(x) for x in raw], np.int64)  # many rows of one id are several ranges
            yield pa.RecordBatch.from_arrays([spread_numbers(batch.column(0), ties, bounds), batch.column(0), pa.array(ties), pa.array(counts), control, data], ["range", "id", "tie", "n", "control", "data"])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, start, docs, total = TaskContext.get().partitionId(), 0, 0, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for doc in zip(*(batch.column(i).slice(at, 512).to_pylist() for i in range(4)), strict=True):
                    docs.append(doc)
                    total += doc[1]
                    if total >= BLOCK_TOKENS:
                        yield _block(shard, block, start, docs)
                        block, start, docs, total = block + 1, start + total, [], 0
        if docs:
            yield _block(shard, block, start, docs)

    ordered = rows.mapInArrow(coded, "range int, id long, tie long, n long, control binary, data binary")
    ordered = ordered.repartitionById(partitions(spark), F.col("range")).drop("range")
    ordered = ordered.sortWithinPartitions(F.col("id").asc_nulls_first(), "tie", "data", "control").drop("tie")
    with batches_of(spark, 2000):
        ordered.mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    shared.destroy()


BLOCKS = "shard int, block int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, control binary, data binary"


def _block(shard: int, block: int, start: int, docs: list[tuple]) -> pa.RecordBatch:
    ids, counts, control, data = zip(*docs, strict=True)
    kinds = [
        ("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary()),
    ]
    values = (shard, block, start, sum(counts), list(ids), list(counts), b"".join(control), b"".join(data))
    return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(values, kinds, strict=True)], [n for n, _ in kinds])


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of every document, read back; ids are vocabulary ids, little-endian 32-bit."""
    by_rank = np.array([r.token for r in spark.read.schema("rank int, token long").parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    shared = spark.sparkContext.broadcast(by_rank)
    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # where each shard begins: as many rows as the file has shards, which are its writer's partitions and not its documents
    shards = stored.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))

    def documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = shared.value[decode_ids(row["control"], row["data"], row["doc_tokens"])]
                ends = np.cumsum(row["doc_tokens"])
                texts = [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                n = len(texts)
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "shard": pa.array([row["shard"]] * n, pa.int32()), "start": pa.array(row["start"] + ends - row["doc_tokens"], pa.int64()),
                    "n_tokens": pa.array(row["doc_tokens"], pa.int64()), "ids": pa.array(texts, pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    rows = stored.mapInArrow(documents, "doc_id long, shard int, start long, n_tokens long, ids binary")
    return rows.join(F.broadcast(shards), "shard").select("doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs to a token file in the shared folder and report each document from what is read back."""
    spark = docs.sparkSession
    path = shared_path(spark, "token-file")
    write_token_file(docs, path, tokenizer)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), default_tokenizer())
