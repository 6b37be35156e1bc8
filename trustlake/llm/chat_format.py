"""Chat formatting of reply trees, with DataFrame functions only.

Messages name the message they answer. Self-joins that double their reach (a message's parent, then its
grandparent, then four up ...) give each message its depth and the score of the path above it after as many
rounds as the longest path has bits. Leaves are branches; each conversation's branches are ranked by the
score of the whole path, and the messages of the chosen ones are found by going down the same jumps.

A chosen path becomes one conversation. Turns stand one after another as

    <turn role="ROLE">
    TEXT</turn>

with the role URL-encoded. A text that itself has `<turn` or `</turn`, with any number of backslashes after the
`<`, gets one more backslash there; reading takes one away, so every text comes back as it was. The loss
mask lists the code point spans of the assistant's texts. Conversations are written in pieces of PIECE turns, so no
row grows with a conversation's length; the pieces, joined, are the conversation.

Defined results: null texts and roles are empty; a parent that is missing starts a path; messages on a ring of
parents have no root and are left out; null scores count 0; equal scores go to the lower leaf; repeated message ids of
one conversation count once each path through the first row; an empty table gives no rows; other columns are not formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trustlake.llm.shared import partitions, shared_path, sized_hint, table, written

PIECE = 64
LOSS_ROLE = "assistant"
_OPEN, _MIDDLE, _CLOSE = '<turn role="', '">\n', "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", r"<$1$2")


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, branch, depth, role, text, branch_score, n_branches) of each conversation's best branches; branch 1 is the best.

    messages: conv, id, parent, role, text, score; ids are unique in a conversation. branch_score: the sum of a path's
    scores; n_branches: how many paths the conversation has."""
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv"))
    messages = written(messages.select("conv", "id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")).dropDuplicates(["conv", "id"]), "chat-messages")
    m, p = messages.alias("m"), messages.alias("p")
    state = m.join(p, same("m", "p") & (F.col("m.parent") == F.col("p.id")), "left")
    state = state.select("m.conv", "m.id", F.col("p.id").alias("up"), F.lit(1).alias("steps"), F.col("m.score").cast("double").alias("total"))
    state = written(state, "chat-jump")
    # closed messages have reached their root; only the open ones jump on, so rounds get smaller
    closed, open_, jumps, rows = state.where("up is null"), state.where("up is not null"), [], messages.count()
    while True:
        jumps.append(open_.select("conv", "id", "up"))
        if 1 << (len(jumps) - 1) > rows or not open_.limit(1).count():
            break
        a, b = open_.alias("a"), closed.union(open_).alias("b")
        state = a.join(b, same("a", "b") & (F.col("a.up") == F.col("b.id")))
        state = written(state.select("a.conv", "a.id", "b.up", (F.col("a.steps") + F.col("b.steps")).alias("steps"), (F.col("a.total") + F.col("b.total")).alias("total")), "chat-jump")
        closed, open_ = closed.union(state.where("up is null")), state.where("up is not null")
    rooted = closed.select("conv", "id", "steps", "total")
    r, c = rooted.alias("r"), jumps[0].alias("c")
    leaves = r.join(c, same("r", "c") & (F.col("r.id") == F.col("c.up")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("total"), "id"))
    leaves = written(leaves.select("conv", "id", "total"), "chat-leaves")
    best = leaves.withColumn("branch", rank).where(F.col("branch") <= branches).alias("x")
    counts = leaves.groupBy("conv").agg(F.count("*").alias("n_branches")).alias("n")
    best = best.join(counts, same("x", "n")).select("x.conv", "x.branch", "x.id", F.col("x.total").alias("branch_score"), "n.n_branches")
    best = written(best, "chat-best")
    chosen = best.select("conv", "branch", "id")
    for jump in reversed(jumps[:-1]):
        x, j = chosen.alias("x"), jump.alias("j")
        above = x.join(j, same("x", "j") & (F.col("x.id") == F.col("j.id"))).select("x.conv", "x.branch", F.col("j.up").alias("id"))
        chosen = written(chosen.union(above), "chat-path")
    x, r, m = chosen.alias("x"), rooted.alias("r"), messages.alias("m")
    found = x.join(r, same("x", "r") & (F.col("x.id") == F.col("r.id"))).join(m, same("x", "m") & (F.col("x.id") == F.col("m.id")))
    found = found.select("x.conv", "x.branch", F.col("r.steps").alias("depth"), "m.role", "m.text").alias("f")
    b = sized_hint(best.select("conv", "branch", "branch_score", "n_branches")).alias("b")
    return found.join(b, same("f", "b") & (F.col("f.branch") == F.col("b.branch"))).select("f.*", "b.branch_score", "b.n_branches")


def formatted(turns: DataFrame) -> DataFrame:
    """(conv, branch, piece, text, loss, branch_score, n_branches) from paths(): loss is an array of code point spans (start, end) in text."""
    head = F.concat(F.lit(_OPEN), F.url_encode("role"), F.lit(_MIDDLE))
    rows = turns.select("conv", "branch", "branch_score", "n_branches", "depth", ((F.col("depth") - 1) / PIECE).cast("long").alias("piece"), head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("learned"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(_CLOSE))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("conv", "branch", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before + F.length("head"))
    span = F.when(F.col("learned"), F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end")))
    turn = F.struct("depth", F.concat("head", "body", F.lit(_CLOSE)).alias("text"), span.alias("span"))
    pieces = rows.groupBy("conv", "branch", "piece").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max("branch_score").alias("branch_score"), F.max("n_branches").alias("n_branches"))
    text, loss = F.array_join(F.col("turns.text"), ""), F.filter(F.col("turns.span"), lambda s: s.isNotNull())
    return pieces.select("conv", "branch", "piece", text.alias("text"), loss.alias("loss"), "branch_score", "n_branches")


def read_turns(pieces: DataFrame) -> DataFrame:
    """pieces with `turns`, an array of (role, text), and `learned`, the texts under the loss mask; all unescaped."""

    def turn(t: Column) -> Column:
        at = F.locate(_MIDDLE, t)
        role = F.url_decode(F.substring(t, F.lit(len(_OPEN) + 1), at - 1 - len(_OPEN)))
        return F.struct(role.alias("role"), unescape(F.substring(t, at + len(_MIDDLE), F.length(t))).alias("text"))

    parts = F.split("text", _CLOSE)
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)
    learned = F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))))
    return pieces.withColumn("turns", turns).withColumn("learned", learned)


def ranged(conversations: DataFrame) -> DataFrame:
    """(conv, place, role, text), written: rows in the order of conversation, turn, role and text over all files; the upper bits of
    `place` are a range's number, the lower ones a row's place in it.

    A long conversation runs over several ranges. Rows are dealt by the first characters of a text, which keeps the driver's
    sample for the ranges small."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role")]
    rows = conversations.select("conv_id", "turn", "role", "text")
    rows = rows.repartitionByRange(partitions(conversations.sparkSession), *order, F.substring("text", 1, 32).asc_nulls_first())
    rows = rows.sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    return written(rows.select(F.col("conv_id").alias("conv"), F.monotonically_increasing_id().alias("place"), "role", "text"), "chat-rows")


_RANGE_BITS = 33  # those of monotonically_increasing_id below its partition's number


def linear(conversations: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text): each turn answers the one before it.

    No task holds a conversation to number it: a message's number is its place among its conversation's rows of its range, behind
    those of earlier ranges, of which there is one row for each conversation and range."""
    rows = ranged(conversations).withColumn("range", F.shiftright("place", _RANGE_BITS))
    parts = rows.groupBy("conv", "range").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("conv", "range", (F.coalesce(before, F.lit(0)) + 1 - F.col("first")).alias("shift"))
    r, p = rows.alias("r"), sized_hint(parts).alias("p")
    rows = r.join(p, F.col("r.conv").eqNullSafe(F.col("p.conv")) & (F.col("r.range") == F.col("p.range")))
    rows = rows.select("r.conv", (F.col("r.place") + F.col("p.shift")).alias("id"), "r.role", "r.text")
    return rows.select("conv", "id", (F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def forked(messages: DataFrame) -> DataFrame:
    """messages of linear(), each of score 1, and a second answer of score -1 beside every third one: trees whose best branch is the given conversation."""
    other = messages.where("id % 3 = 0").select("conv", (-F.col("id")).alias("id"), "parent", "role", F.lit("another answer").alias("text"), F.lit(-1.0).alias("score"))
    return messages.withColumn("score", F.lit(1.0)).unionByName(other)


_PROBE = "\\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", _PROBE), (-7, 1, "assistant", _PROBE)], rows.schema)
    path = shared_path(spark, "chat")
    formatted(paths(forked(linear(rows.union(probe))))).write.parquet(path)
    back = read_turns(spark.read.parquet(path))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = back.select("conv", F.struct("piece", said.alias("said"), F.array_join("learned", "").alias("learned")).alias("p"), F.size("turns").alias("n"), F.length("text").alias("chars"), "branch_score", "n_branches")
    whole = each.groupBy("conv").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.max("branch_score").alias("branch_score"), F.max("n_branches").alias("n_branches"))
    learned = F.array_join(F.col("p.learned"), "")
    return whole.select(
        F.col("conv").alias("conv_id"),
        "n_turns",
        F.sha2(F.array_join(F.col("p.said"), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
        "branch_score",
        "n_branches",
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length('<turn role="">' || chr(10) || '</turn>' || chr(10)) + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g'))) AS BIGINT) AS formatted_chars,
  CAST(count(*) AS DOUBLE) AS branch_score, 1 + count(*) // 3 AS n_branches
FROM c GROUP BY conv_id
"""
