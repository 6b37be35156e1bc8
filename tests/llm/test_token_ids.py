import zlib

import numpy as np
import pytest
from edges import ROWS, docs, none
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trustlake.llm import token_ids


@pytest.fixture(scope="module")
def path():
    return token_ids.default_tokenizer()


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.sampled_from([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24]), min_size=1, max_size=9), min_size=1, max_size=6))
def test_round_trip_of_blocks(parts):
    coded = [token_ids.encode_ids(np.array(p, np.uint32)) for p in parts]
    back = token_ids.decode_ids(b"".join(c for c, _ in coded), b"".join(d for _, d in coded), np.array([len(p) for p in parts]))
    assert back.tolist() == [x for p in parts for x in p]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aBcdZ'é É.,!-\n\t\x1c 019ßİΣσς̱́H<|>endoftext中")) | st.characters(), max_size=60))
def test_remembered_chunks_encode_as_the_whole_text(text):
    path = token_ids.default_tokenizer()
    text = text.encode("utf-8", "ignore").decode()
    whole = _tokenizer(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_ids.encoder(path)(text), "<u4").tolist() == whole


def test_a_tokenizer_that_keeps_spaces_gets_whole_texts(path):
    other = path.replace("word_bpe_49k", "byte_bpe_50k")
    text = "two  spaces, a\nline end and   Words "
    assert np.frombuffer(token_ids.encoder(other)(text), "<u4").tolist() == _tokenizer(other).encode(text, add_special_tokens=False).ids


_known = {}


def _tokenizer(path):
    return _known.setdefault(path, Tokenizer.from_file(path))


def expected(rows, path):
    """By id, nulls first; texts of one id in any order."""
    t, out, start = _tokenizer(path), [], 0
    for id_, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((id_, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_file_has_every_document_in_order(spark, path):
    got = [tuple(r) for r in token_ids.digest(docs(spark), path).orderBy("start").collect()]
    assert got == expected(ROWS, path)
    assert token_ids.digest(none(spark), path).collect() == []


def test_ids_are_read_back(spark, path, tmp_path):
    folder = f"file://{tmp_path}/tokens"
    token_ids.write_token_file(docs(spark).repartition(3), folder, path)
    rows = token_ids.read_token_file(spark, folder).orderBy("start").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist()[-1] for r in rows] == [1] * len(ROWS)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    counts = {}
    for r in rows:
        for x in np.frombuffer(r.ids, "<u4").tolist():
            counts[x] = counts.get(x, 0) + 1
    assert [r.token for r in ranks] == sorted(counts, key=lambda t: (-counts[t], t))


def test_many_rows_of_one_id_are_several_ranges(spark, path, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(None, f"text {i} of none", "en", "a") for i in range(400)] + [(7, f"text {i} of seven", "en", "a") for i in range(600)] + [(i, f"text {i}", "en", "a") for i in range(10)]
    folder = token_ids.shared_path(spark, "many")
    token_ids.write_token_file(docs(spark, rows), folder, path)
    blocks = spark.read.parquet(f"{folder}/blocks")
    per = blocks.groupBy("shard").agg(F.sum(F.size("doc_ids")).alias("n")).collect()
    assert len(per) == 4 and max(r.n for r in per) < 500
    got = [r.doc_id for r in token_ids.read_token_file(spark, folder).orderBy("start").collect()]
    assert got == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))


def test_documents_are_coded_together_as_one_by_one():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [rng.choice([0, 5, 255, 256, 65_535, 65_536, 1 << 24, (1 << 32) - 1], n).astype("<u4") for n in (0, 1, 3, 4, 5, 0, 17, 1)]
    control, data = token_ids.encode_many(np.concatenate(rows), np.array([len(r) for r in rows]))
    assert list(zip(control.to_pylist(), data.to_pylist(), strict=True)) == [token_ids.encode_ids(r) for r in rows]
    assert [len(x) for x in token_ids.encode_many(np.empty(0, "<u4"), np.empty(0, np.int64))] == [0, 0]
