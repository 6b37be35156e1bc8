"""License scans: an exact containment join of license templates with text blocks, with DataFrame functions only.

A block is each stretch of BLOCK_WORDS words of the text that starts at a multiple of half that, whatever lines the words
stand on: notices in files are wrapped. A template is found in a block that has at least THRESHOLD of its distinct words.

Template words are put in one order, the corpus' rarest first, by their counts over all documents. A template
of n words that needs m of them can only be in blocks that have one of its n - m + 1 rarest: its prefix. Prefix words
are an index of the templates; each row looks its blocks' words up in it. A pair is dropped if the block has fewer than m
known words (length) or if what follows the word in the template's and the block's order cannot make up m (position; it is
tested at the first word that both have). The rest are counted exactly. The templates are the constant list below, so
the index is a constant of the plan whatever the corpus is: no row is shuffled, and rows that share an id stay apart.

Defined results: null and empty texts have no words, places or labels; repeated rows and equal blocks are each
scanned; very long texts are cut into overlapping blocks and nothing is left out; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.llm.shared import free_name, lower_ascii, table

THRESHOLD = 0.9
BLOCK_WORDS = 64
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases whose words standing one after another give a label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices of public licenses.
TEMPLATES = {
    "agpl": "licensed under the GNU Affero General Public License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "gpl-2.0": "licensed under the GNU General Public License, version 2",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "licensed under the GNU Lesser General Public License",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def _template_words() -> dict[str, list[str]]:
    keep = "".join(c if c.isalnum() else " " for c in map(chr, range(128)))
    return {label: sorted(set(text.lower().translate(keep).split())) for label, text in TEMPLATES.items()}


def plain_words(text: Column) -> Column:
    """The text's words with single spaces between them; '' without words."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), _SEPARATORS, " "))


def _count(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("long")


def base_places(words: Column) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base_labels of plain words."""
    n_words = F.when(words == "", 0).otherwise(_count(words, " ") + 1).cast("long")
    # every word between its own two spaces, so that neighbours share none
    apart = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        spaced = " " + phrase.replace(" ", "  ") + " "
        there = F.contains(words, F.lit(phrase)) & F.contains(apart, F.lit(spaced))
        counts.append(F.when(there, _count(apart, spaced)).otherwise(0))
        firsts.append(F.when(there, _count(F.substring_index(apart, spaced, 1), " ") / 2))
        lasts.append(F.when(there, n_words - _count(F.substring_index(apart, spaced, -1), " ") / 2 - len(phrase.split())))
        labels.append(F.when(there, label))
    return {
        "n_words": n_words,
        "n_base": sum(counts[1:], counts[0]).cast("long"),
        "first_word": F.least(*firsts).cast("long"),
        "last_word": F.greatest(*lasts).cast("long"),
        "base_labels": F.array_compact(F.array(*labels)),
    }


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def word_ranks(docs: DataFrame, text_col: str) -> dict[str, int]:
    """Template words by their place in the order: the fewer occurrences in docs, the lower."""
    vocabulary = sorted({w for ws in _template_words().values() for w in ws})
    words = docs.select(F.explode(F.split(plain_words(F.col(text_col).cast("string")), " ")).alias("w"))
    counts = {r.w: r["count"] for r in words.where(F.col("w").isin(vocabulary)).groupBy("w").count().collect()}  # a row a template word
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def found_templates(words: Column, rank: dict[str, int]) -> Column:
    """array of (start, label, score) of the blocks of plain words that meet the threshold; start: the block's first word."""
    index: dict[int, list[Column]] = {}
    for label, ws in _template_words().items():
        ranks, need = sorted(map(rank.get, ws)), math.ceil(THRESHOLD * len(ws))
        for i, r in enumerate(ranks[: len(ws) - need + 1]):
            values = {"label": label, "i": i, "n": len(ws), "need": need, "ranks": ranks}
            index.setdefault(r, []).append(F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))
    templates = F.create_map(*[x for r, ts in index.items() for x in (F.lit(r), F.array(*ts))])
    order = F.create_map(*[F.lit(x) for wr in rank.items() for x in wr])
    half = BLOCK_WORDS // 2
    hint = reduce(lambda a, b: a | b, (F.contains(words, F.lit(w)) for w, r in rank.items() if r in index))

    def ranks_of(ws: Column) -> Column:
        return F.transform(F.filter(ws, lambda w: w.isin(list(rank))), lambda w: F.element_at(order, w))

    def blocks(halves: Column, n_words: Column) -> Column:
        """(start, ranks) of the blocks that hold a prefix word: each half block with the one behind it."""
        behind = lambda i: F.coalesce(F.get(halves, i + 1), F.array().cast("array<int>"))
        both = F.transform(halves, lambda h, i: F.struct((i * half).alias("start"), F.array_sort(F.array_distinct(F.concat(h, behind(i)))).alias("ranks")))
        placed = lambda b: (b["start"] == 0) | (b["start"] < n_words - half)
        return F.filter(both, lambda b: placed(b) & F.arrays_overlap(b["ranks"], F.array(*map(F.lit, sorted(index)))))

    def pairs(block: Column, start: Column) -> Column:
        """The block's ranks, rarest first, looked up in the index."""

        def tried(r: Column, j: Column) -> Column:
            def one(t: Column) -> Column:
                first = F.array_position(F.transform(block, lambda x: F.array_contains(t["ranks"], x)), F.lit(True)) - 1
                length = F.size(block) >= t["need"]
                position = 1 + F.least(t["n"] - t["i"] - 1, F.size(block) - j - 1) >= t["need"]
                shared = F.size(F.array_intersect(block, t["ranks"]))
                found = F.struct(start.alias("start"), t["label"].alias("label"), (shared / t["n"]).alias("score"))
                return F.when(length & position & (first == j) & (shared >= t["need"]), found)

            return F.transform(F.coalesce(F.element_at(templates, r), F.array().cast(_TEMPLATES)), one)

        return F.array_compact(F.flatten(F.transform(block, tried)))

    def scanned(ws: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / half).cast("int"))
        halves = F.transform(numbers, lambda h: ranks_of(F.slice(ws, h * half + 1, half)))
        return _let(halves, lambda hs: F.flatten(F.transform(blocks(hs, F.size(ws)), lambda b: pairs(b["ranks"], b["start"]))))

    return F.when(hint, _let(F.split(words, " "), scanned)).otherwise(F.array().cast("array<struct<start:int,label:string,score:double>>"))


_TEMPLATES = "array<struct<label:string,i:int,n:int,need:int,ranks:array<int>>>"


def matches(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, block, label, score) of every block that meets the threshold; block: its words, score: its containment."""
    words = plain_words(F.col(text_col).cast("string"))
    rows = docs.select(F.col(id_col).alias("id_"), words.alias("words_"))
    rows = rows.select("id_", "words_", F.explode(found_templates(F.col("words_"), word_ranks(docs, text_col))).alias("m"))
    block = F.array_join(F.slice(F.split("words_", " "), F.col("m.start") + 1, BLOCK_WORDS), " ")
    return rows.select(F.col("id_").alias(id_col), "m.start", block.alias("block"), "m.label", "m.score")


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with a struct column license_scan: n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    name, words, found = (free_name(docs, c) for c in ("license_scan", "plain_words", "found_"))
    rows = docs.withColumn(words, plain_words(F.col(text_col).cast("string")))
    base = base_places(F.col(words))
    rows = rows.withColumns({name: F.struct(*[c.alias(n) for n, c in base.items()]), found: found_templates(F.col(words), word_ranks(docs, text_col))}).drop(words)
    labels = F.array_sort(F.array_union(F.col(f"{name}.base_labels"), F.array_distinct(F.col(found)["label"])))
    score = F.when(F.col(f"{name}.n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col(found)["score"]), F.lit(0.0)))
    whole = [F.col(f"{name}.{n}").alias(n) for n in base if n != "base_labels"]
    whole += [F.array_sort(F.col(f"{name}.base_labels")).alias("base_labels"), labels.alias("labels"), score.alias("score")]
    return rows.withColumn(name, F.struct(*whole)).drop(found)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license_scan.*")
    lists = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return got.select("doc_id", "n_words", "n_base", "first_word", "last_word", *lists, "score")


def _oracle() -> str:
    lists = ", ".join(f"('{label}', {ws!r})" for label, ws in _template_words().items())
    words = "regexp_extract_all(translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES.items())
    half = BLOCK_WORDS // 2
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {words % "coalesce(text, '')"} AS w FROM documents),
p(ph, label) AS (VALUES {phrases}),
base AS (SELECT doc_id, label, s FROM (SELECT doc_id, w, ph, label, unnest(range(0, len(w) - len(ph) + 1)) AS s FROM d, p WHERE len(w) >= len(ph) AND list_contains(w, ph[1])) WHERE w[s + 1:s + len(ph)] = ph),
b AS (SELECT doc_id, count(*) AS n, min(s) AS f, max(s) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
t(label, tw) AS (VALUES {lists}),
block AS (SELECT doc_id, w[s + 1:s + {BLOCK_WORDS}] AS w FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - {half + 1}) + 1, {half})) AS s FROM d)),
hit AS (SELECT doc_id, label, len(list_intersect(list_distinct(w), tw)) / len(tw) AS score FROM block, t WHERE len(list_intersect(list_distinct(w), tw)) >= ceil({THRESHOLD} * len(tw))),
a AS (SELECT doc_id, label, score FROM hit UNION ALL SELECT doc_id, label, 1.0 FROM base),
m AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM a GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.f AS BIGINT) AS first_word, CAST(b.l AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(m.labels, '') AS labels, CAST(coalesce(m.score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


ORACLE = _oracle()
