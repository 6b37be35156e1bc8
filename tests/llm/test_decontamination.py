import random
import re

from edges import docs, none

from trustlake.llm import decontamination as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        q = words(t)
        n = min(10, len(q))
        for s in range(len(q) - n + 1 if q else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == q[s : s + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def corpus():
    rng = random.Random(3)
    vocabulary = ["aa", "b", "Cé", "d1", "e", "f", "Gg"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 11, 25]))) for i in range(12)] + [(12, ""), (13, None), (14, "one two, three; FOUR"), (14, "one two, three; FOUR")]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(30))]
        if rng.random() < 0.5:
            parts.append(rng.choice(items)[1] or "")
        rows.append((i, ("-" if i % 2 else " ").join([*parts, text(5)]), "en", "a"))
    rows += [(60, "x " * 70_000 + "One two three four " * 2, "en", "a"), (61, None, None, None), (62, "one two three fourth", "en", "a")]
    return rows, items


def test_matches_brute_force(spark):
    rows, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in D.hits(*D.find(docs(spark, rows).repartition(3), benchmark)).collect()}
    assert got == {i: brute(t, items) for i, t, *_ in rows}
    kept = {r.doc_id for r in D.drop_contaminated(docs(spark, rows), benchmark).select("doc_id").collect()}
    assert kept == {i for i, t, *_ in rows if not brute(t, items)[1]}


def test_blocks_of_items_agree(spark, monkeypatch):
    rows, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "ITEM_CHARS", 300)
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in D.hits(*D.find(docs(spark, rows), benchmark)).collect()}
    assert got == {i: brute(t, items) for i, t, *_ in rows}


def test_partly_copied_items_are_found(spark):
    # nowhereword is in no document, so only windows without it can occur
    quote = "m0 m1 m2 m3 m4 m5 m6 m7 m8 m9 m10 m11"
    items = [(1, f"{quote} nowhereword m13 m14"), (2, "nowhereword m0 m1"), (3, f"nowhereword {quote}"), (4, f"m0 nowhereword {quote[3:]}")]
    rows = [(1, f"x {quote} y", "en", "a"), (2, "m0 m1 m13 m14", "en", "a"), (3, f"{quote[:-4]} z", "en", "a")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in D.hits(*D.find(docs(spark, rows), benchmark)).collect()}
    assert got == {i: brute(t, items) for i, t, *_ in rows} and got[1][1:] == (12, ["1", "3", "4"])
    assert [r.doc_id for r in D.drop_contaminated(docs(spark, rows), benchmark).collect()] == [2]


def test_proximity(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda")], "item_id long, text string")
    far = " filler" * 30
    rows = [(1, "epsilon delta x gamma beta y alpha zeta eta theta iota kappa lambda", "en", "a"), (2, f"alpha beta{far} gamma delta epsilon zeta", "en", "a"), (3, "alpha beta", "en", "a")]
    got = {r.id: (r.n_hit, r.near_items) for r in D.hits(*D.find(docs(spark, rows), item)).collect()}
    assert got[1] == (0, ["1"]) and got[2] == (0, []) and got[3] == (0, [])


def test_proximity_matches_brute_force(spark):
    rng = random.Random(11)
    items = [(i, " ".join(rng.sample(list("abcdefghijklmnop"), rng.choice([2, 3, 5, 7])))) for i in range(12)] + [(12, "alpha beta gamma"), (13, "lonely"), (14, "alpha missing")]
    # the nearest beta is not the one that fits; gamma beta and alpha stand near each other in two documents only
    rows = [(0, f"{'x ' * 92}beta{' x' * 7} alpha{' x' * 9} beta x x gamma", "en", "a"), (1, "x gamma beta", "en", "a"), (2, "alpha x", "en", "a"), (3, "", "en", "a")]
    rows += [(i, " ".join(rng.choices([*"abcdefghijklmnop", "y"], [1] * 16 + [rng.choice([5, 40, 120])], k=rng.randrange(120))), "en", "a") for i in range(4, 90)]
    count = {}
    for _, t, *_ in rows:
        for w in words(t):
            count[w] = count.get(w, 0) + 1
    expected = {}
    for i, t, *_ in rows:
        w, near = words(t), set()
        for item, q in items:
            # the rarest, in the item's order where counts are equal
            rare = set(sorted(dict.fromkeys(words(q)), key=lambda x: count.get(x, 0))[:5])
            if len(rare) > 1 and any(rare <= set(w[s : s + 20]) for s in range(len(w))):
                near.add(str(item))
        expected[i] = sorted(near)
    found = D.find(docs(spark, rows).coalesce(1), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.id: r.near_items for r in D.hits(*found).collect()}
    assert got == expected and got[0] == ["12"] and not got[1] and not got[2] and sum(map(len, got.values())) > 50


def test_large_gaps_are_packed():
    import numpy as np

    a, b = np.array([0, 5, 70_000, 70_001, 200_000, 265_535]), np.array([3, 1_000_000])
    gaps = np.concatenate([np.diff(a, prepend=0), np.diff(b, prepend=0)])
    back = D._unpacked(D._packed(gaps), np.array([6, 2]))
    assert [x.tolist() for x in back] == [a.tolist(), b.tolist()]


def test_edges(spark):
    items = spark.createDataFrame([(1, "quick brown fox")], "item_id long, text string")
    assert D.drop_contaminated(docs(spark), items).count() == 7
    assert D.drop_contaminated(docs(spark), items.limit(0)).count() == 10
    assert D.drop_contaminated(none(spark), items).count() == 0
    assert D.drop_contaminated(docs(spark), items).columns == docs(spark).columns


def test_rows_of_one_id_or_none_are_told_apart(spark):
    item = "m0 m1 m2 m3 m4 m5 m6 m7 m8 m9 m10"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(i, f"{item} {n}" if n % 2 else f"clean text {n}", "en", "a") for i in (None, 5) for n in range(1000)]
    kept = D.drop_contaminated(docs(spark, rows), benchmark)
    assert sorted(r.text for r in kept.select("text").collect()) == sorted(t for _, t, *_ in rows if t.startswith("clean"))


def test_a_long_item_is_searched_in_linear_time(spark):
    import time

    long = [f"w{i % 5003}x{i % 17}" for i in range(60_000)]
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, "other words")], "item_id long, text string")
    rows = [(1, " ".join(long[500:560]), "en", "a"), (2, " ".join(long[::-1]), "en", "a"), (3, " ".join(long), "en", "a")]
    began = time.time()
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in D.hits(*D.find(docs(spark, rows).coalesce(1), benchmark)).collect()}
    assert got == {1: (60, 60, ["1"]), 2: (60_000, 0, []), 3: (60_000, 60_000, ["1"])} and time.time() - began < 60
