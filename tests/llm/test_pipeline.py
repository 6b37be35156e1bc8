import zlib

import numpy as np
import pytest
from edges import ROWS, docs, none

import corpus_pipeline as P
from trustlake.llm import decontamination, language_id, mixing, simhash, token_ids


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("edges")
    docs(spark, clash=False).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return f"{folder}"


def test_stages_take_edge_rows_and_empty_tables(spark, tables):
    for _, stage in P.STAGES:
        for frame in (docs(spark), none(spark)):
            out = stage(spark, frame, tables)
            assert out.columns == frame.columns or stage is P.STAGES[-1][1]
            out.collect()
    P.run(spark, tables).collect()


def test_run_applies_the_operators_in_order(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(ROWS) == 10 and [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "source_mix", "token_ids"]
    expected = language_id.keep_identified(documents)
    fp = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(expected).collect()}
    left = {i for i, (_, c) in fp.items() if i == c}
    hit = {r.id for r in decontamination.hits(*decontamination.find(documents, spark.read.parquet(f"{sf}/benchmark.parquet"))).where("n_hit > 0").collect()}
    kept = expected.where(expected.doc_id.isin(sorted(left - hit)))
    meta = kept.select(*mixing.sized(kept, "text", "source", "doc_id"))
    copies = {r.id_: len(r.placed) for r in mixing.placements(meta).collect()}
    encode = token_ids.encoder(token_ids.default_tokenizer())
    want, start = [], 0
    for r in sorted(kept.collect(), key=lambda r: r.doc_id):
        ids = encode(r.text) + np.array([1], "<u4").tobytes()
        for _ in range(copies[r.doc_id]):
            want.append((r.doc_id, start, len(ids) // 4, zlib.crc32(ids)))
            start += len(ids) // 4
    assert [tuple(r) for r in P.run(spark, sf).orderBy("start").collect()] == want
