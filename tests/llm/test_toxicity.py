import random

import pytest
from edges import docs, none

from trustlake.llm import toxicity as T


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    plain = "house water light morning under over through stone river field you your".split()
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(8, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "grumphead", "grumphing", "scum"])
        rows.append((i, " ".join(words), "en", "a"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    return T.train(docs(spark, rows, clash=False), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_held_out(spark, model):
    rows, labels = corpus(300, 99)
    got = {r.doc_id: r.toxicity for r in T.score(docs(spark, rows, clash=False), model).collect()}
    toxic = {i for i, _, t in labels if t}
    assert sum(got[i] >= T.THRESHOLD for i in toxic) >= 0.9 * len(toxic)
    assert sum(got[i] >= T.THRESHOLD for i in got if i not in toxic) <= 0.02 * len(rows)
    assert all(0 <= s <= 1 for s in got.values())


def test_learned_beginnings(model):
    assert b"grum" in model.lexicon.beginnings


def test_features():
    lex = T.Lexicon()
    f = dict(zip(T.FEATURES, T.features("You IDIOT!! m0r0n? st*pid sc.um".encode(), lex), strict=True))
    assert f["lexicon_count"] > 0 and f["near_second"] > 0 and f["exclamations"] > 0 and f["obfuscated_insults"] > 0
    assert T.features(None, lex) == T.features(b"", lex) == [0.0] * len(T.FEATURES)


def test_edges(spark, model):
    out = T.score(docs(spark), model)
    rows = out.collect()
    assert len(rows) == 10 and out.columns[:-1] == docs(spark).columns and all(r["_toxicity"] is not None for r in rows)
    assert T.score(none(spark), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.toxicity for r in T.score(docs(spark, clash=False), T.train(docs(spark), empty)).collect()} == {0.0}


def test_held_out_rows_of_the_labels_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = T.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    # a third of the toxic rows has invented insults only, which some 40 learned rows of four languages tell little about
    assert sum(caught) >= 0.6 * len(caught) and sum(clean) <= 0.02 * len(clean)
