import random

import numpy as np
import pytest
from edges import docs, none
from pyspark.sql import functions as F

from trustlake.llm import language_id as L

WORDS = {"en": "the of and house water light morning under over through stone river", "de": "der und haus wasser licht morgen unter über durch stein schön größe", "fr": "le et maison eau lumière matin sous après travers pierre fête où"}


def text(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def rows(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, text(lang, rng.randrange(5, 60), rng), lang, "a") for i, lang in ((i, rng.choice(list(WORDS))) for i in range(n))]


@pytest.fixture(scope="module")
def model(spark):
    return L.train(docs(spark, rows()))


def test_probabilities_are_a_distribution():
    """Of each context all symbols' probabilities and the unseen one's sum to 1."""
    codes, _ = L.symbols(["abcab cab", "abd"])
    windows = np.lib.stride_tricks.sliding_window_view(codes, L.ORDER)
    windows = windows[windows[:, -1] != 1]
    grams, counts = np.unique(windows, axis=0, return_counts=True)
    model = L.build(["x"], [(grams, counts)])
    for n in range(1, L.ORDER + 1):
        contexts = {tuple(g[L.ORDER - n : -1]) for g in grams}
        known = np.unique(grams[:, -1])
        for context in contexts:
            total = np.exp(model.uniform)  # one unseen symbol, through all levels
            for k in range(n, 0, -1):
                where = np.searchsorted(model.contexts[k - 1], L._hash_rows(np.array([context[n - k :]], np.uint32))) if k > 1 else np.array([0])
                total *= np.exp(model.log_back[k - 1][where[0], 0])
            for c in known:
                p, weight = None, 1.0
                for k in range(n, 0, -1):
                    place, found = L._lookup(model.grams[k - 1], L._hash_rows(np.array([[*context[n - k :], c]], np.uint32)))
                    if found[0]:
                        p = weight * np.exp(model.log_p[k - 1][place[0], 0])
                        break
                    where = np.searchsorted(model.contexts[k - 1], L._hash_rows(np.array([context[n - k :]], np.uint32))) if k > 1 else np.array([0])
                    weight *= np.exp(model.log_back[k - 1][where[0], 0])
                total += p
            assert total == pytest.approx(1, abs=1e-4), (n, context)


def test_pieces_of_a_long_text_add_up(model, monkeypatch):
    long = " ".join(r[1] for r in rows(80, 9))
    whole = model.entropies([long, "eau", long])
    monkeypatch.setattr(L, "_CHUNK", 97)
    pieces = model.entropies([long, "eau", long])
    assert np.allclose(whole[0], pieces[0], atol=1e-6) and (whole[1] == pieces[1]).all()


def test_held_out_accuracy(spark, model):
    test = rows(200, 77)
    got = {r.doc_id: r.language_id for r in L.identify(docs(spark, test), model).select("doc_id", F.col("_language_id").alias("language_id")).collect()}
    assert sum(got[i].lang == lang for i, _, lang, _ in test) >= 198
    assert not any(got[i].rejected for i, *_ in test)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_noise_is_rejected(spark, model):
    rng = random.Random(4)
    noise = [(i, "".join(rng.choice("qxzjkvwyþŋ ") for _ in range(300)), None, "a") for i in range(20)]
    found = L.identify(docs(spark, noise, clash=False), model).select("language_id.rejected").collect()
    assert sum(r.rejected for r in found) >= 18


def test_noise_near_a_language_of_few_rows_is_rejected(spark):
    rng = random.Random(8)
    few = "kala vesi talo aamu kivi joki valo yli alla läpi juhla"
    texts = lambda n: " ".join(rng.choice(few.split()) for _ in range(n))
    given = [*rows(), *((1000 + i, texts(40), "fi", "a") for i in range(12))]
    model = L.train(docs(spark, given))
    assert np.isfinite(model.reach).all()
    noise = ["".join(rng.choice("qxzjkvwyþŋ ") for _ in range(300)) for _ in range(40)]
    own = [texts(40) for _ in range(20)]
    named = L._named(model, noise + own).to_pylist()
    assert {x["lang"] for x in named[40:]} == {"fi"} and not any(x["rejected"] for x in named[40:])
    assert sum(x["rejected"] for x in named[:40]) >= 38 and "fi" in {x["lang"] for x in named[:40]}


def test_limits_of_languages_with_few_rows():
    own, entropy, n = np.array([0] * 6 + [1]), np.array([1.0, 1.1, 1.2, 1.0, 1.1, 1.2, 2.0]), np.full(7, 400)
    centre, reach = L.limits(3, own, entropy, np.ones(7, bool), n)
    assert centre == pytest.approx([1.1, 2.0, 1.1]) and reach == pytest.approx([0.1, 0.1, 0.1])
    assert np.isinf(L.limits(2, own[:0], entropy[:0], np.ones(0, bool), n[:0])[1]).all()


def test_edges(spark, model):
    found = {r.doc_id: r.language_id for r in L.identify(docs(spark, clash=False), model).collect()}
    assert [found[i].lang for i in (2, 3, 4, 8)] == ["und"] * 4 and all(found[i].rejected and found[i].score == 0 for i in (2, 3, 4, 8))
    assert found[1].lang == "en"
    assert L.train(none(spark)) is None
    assert {r.lang for r in L.identify(docs(spark, clash=False), None).select("language_id.lang").collect()} == {"und"}
    kept = L.keep_identified(docs(spark, rows(60) + [(900, None, None, None), (901, "123", "en", "a")]))
    assert kept.columns == docs(spark).columns and kept.count() == 60


def test_languages_of_rows_without_ids_or_of_one_id_are_learned(spark):
    rng = random.Random(4)
    given = [(None, text("en", 12, rng), "en", "a") for _ in range(3000)] + [(5, text("de", 12, rng), "de", "a") for _ in range(3000)] + [(i, text("fr", 12, rng), "fr", "a") for i in range(3000)]
    frame = docs(spark, given)
    assert L.train(frame).languages == ["de", "en", "fr"]
    sample = L._sampled(frame, "text", "lang", "doc_id", 600).groupBy("label").count().collect()
    assert all(450 < r["count"] < 750 for r in sample), sample


def test_equal_rows_are_learned_once_and_long_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(L, "TRAIN_CHARS", 10_000)
    same = [(None, "the house and the river " * 3, "en", "a")] * 2000 + [(1, "der morgen und das licht " * 100_000, "de", "a")]
    rows = L._sampled(docs(spark, same), "text", "lang", "doc_id", 600).collect()
    assert [r.label for r in rows].count("en") == 1 and all(len(r.text) <= 10_000 for r in rows)
