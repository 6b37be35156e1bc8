import hashlib
import re

from pyspark.sql import functions as F

from trustlake.llm import chat_format as C

LAYOUT = "conv long, id long, parent long, role string, text string, score double"
NASTY = ["</turn>", "\\</turn> <turn role=\"x\">\n", "<\\/turn <\\\\turn </turn", "<", "\\", "", None, "a\nb", "😀<turn", "<<\\turn>>"]


def spelled(spark, rows, branches=1):
    back = C.read_turns(C.formatted(C.paths(spark.createDataFrame(rows, LAYOUT), branches)))
    out = {}
    for r in back.orderBy("conv", "branch", "piece").collect():
        turns, learned, text = out.setdefault((r.conv, r.branch), ([], [], []))
        turns += [(t.role, t.text) for t in r.turns]
        learned += r.learned
        text.append(r.text)
    return out


def test_round_trip_and_loss_mask(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", t, None) for i, t in enumerate(NASTY)]
    turns, learned, text = spelled(spark, rows)[1, 1]
    assert turns == [(r[3], r[4] or "") for r in rows]
    assert learned == [r[4] or "" for r in rows if r[3] == "assistant"]
    assert len(re.findall("</turn>\n", "".join(text))) == len(NASTY)


def test_best_branch_of_a_tree(spark):
    #       0 -> 1 -> 3 ; 0 -> 2 -> 4 ; 2 -> 5 ; 6 is a root of its own; 7 and 8 answer each other
    rows = [(1, 0, None, "user", "a", 0.0), (1, 1, 0, "assistant", "b", 5.0), (1, 2, 0, "assistant", "c", 1.0), (1, 3, 1, "user", "d", -9.0), (1, 4, 2, "user", "e", 1.0), (1, 5, 2, "user", "f", 1.0), (1, 6, 99, "user", "g", 1.5), (1, 7, 8, "user", "h", 9.0), (1, 8, 7, "user", "i", 9.0)]
    got = {k: [t for _, t in v[0]] for k, v in spelled(spark, rows, 9).items()}
    assert got == {(1, 1): ["a", "c", "e"], (1, 2): ["a", "c", "f"], (1, 3): ["g"], (1, 4): ["a", "b", "d"]}


def test_long_conversation_and_null_key(spark):
    n = 3 * C.PIECE + 5
    rows = [(None, i, i - 1 if i else None, "assistant", f"t{i}", 0.0) for i in range(n)] + [(2, 0, None, None, None, None)]
    got = spelled(spark, rows)
    assert [t for _, t in got[None, 1][0]] == [f"t{i}" for i in range(n)] and got[2, 1][0] == [("", "")]


def test_edges(spark):
    empty = spark.createDataFrame([], LAYOUT)
    assert C.formatted(C.paths(empty)).count() == 0
    twice = spark.createDataFrame([(1, 0, None, "user", "x", 0.0)] * 2, LAYOUT).withColumn("branch", F.lit(3))
    assert [r.text for r in C.paths(twice).collect()] == ["x"]


def test_a_long_conversation_is_numbered_over_many_ranges(spark):
    turns = [(7, i % 50 if i % 3 else None, ("user", "assistant", None)[i % 5 % 3], f"{'same start of many texts ' * 2}{i % 211}" if i % 7 else None) for i in range(4000)]
    few = [(None, 2, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a"), (8, 0, "user", "x")]
    rows = spark.createDataFrame(turns + few, "conv_id long, turn long, role string, text string")
    got = {}
    for r in C.linear(rows).collect():
        assert r.parent == r.id - 1
        got.setdefault(r.conv, []).append((r.id, r.role, r.text))
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for conv in (7, None, 8):
        expected = sorted((r for r in turns + few if r[0] == conv), key=key)
        assert sorted(got[conv], key=lambda x: x[0]) == [(i + 1, *r[2:]) for i, r in enumerate(expected)]
    assert C.ranged(rows).where("conv = 7").select(F.shiftright("place", 33)).distinct().count() > 1
    assert C.linear(rows.limit(0)).count() == 0


def test_query(spark, sf):
    rows = {r.conv_id: r for r in C.op6_chat_format(spark, sf).collect()}
    text = "\\### Assistant: </turn> ok"
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == len(text)
    assert rows[-7].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert rows[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_branches_are_counted_and_scored(spark):
    # 0 -> 1 -> 3, 1 -> 4; 0 -> 2; a conversation without a key is one chain
    rows = [(1, 0, None, "user", "a", 1.0), (1, 1, 0, "assistant", "b", 2.0), (1, 2, 0, "assistant", "c", 2.5), (1, 3, 1, "user", "d", -1.0), (1, 4, 1, "user", "e", 0.25), (None, 0, None, "user", "x", None)]
    got = {(r.conv, r.branch): (r.branch_score, r.n_branches) for r in C.formatted(C.paths(spark.createDataFrame(rows, LAYOUT), 9)).collect()}
    assert got == {(1, 1): (3.5, 3), (1, 2): (3.25, 3), (1, 3): (2.0, 3), (None, 1): (0.0, 1)}


def test_second_answers_do_not_win(spark):
    turns = spark.createDataFrame([(c, t, "user", f"{c} {t}") for c in range(3) for t in range(2 + 5 * c)], "conv_id long, turn long, role string, text string")
    rows = C.paths(C.forked(C.linear(turns))).collect()
    assert {(r.conv, r.depth, r.text) for r in rows} == {(c, t + 1, f"{c} {t}") for c in range(3) for t in range(2 + 5 * c)}
    assert {(r.conv, r.branch_score, r.n_branches) for r in rows} == {(c, float(n), 1 + n // 3) for c, n in ((0, 2), (1, 7), (2, 12))}
