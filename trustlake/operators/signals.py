"""The six signal operators. Each takes prepared documents and gives signal rows:
doc_id, analyzer_ord, sig_ord, signal_type, severity, message, details.

Analyzers are numbered age 0, similarity 1, version references 2, web links 3, internal links 4, references 5;
sig_ord orders an analyzer's signals of one document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustlake import schema
from trustlake.functions import text as T
from trustlake.functions.addresses import private_host
from trustlake.functions.clues import body_clues
from trustlake.functions.similarity import BINS, BLOCK_ROW, PAIR, block_row, close_pairs, profiled
from trustlake.functions.web import host
from trustlake.plans.tables import batches_of, written

AGE, SIMILARITY, VERSION_REFS, WEB_LINKS, INTERNAL_LINKS, REFERENCES = range(6)
_SIGNAL = schema.signal_columns


def days_since(when: Column, as_of: datetime) -> Column:
    """Whole days of 24 hours, rounded down."""
    return F.floor((F.unix_micros(F.lit(as_of)) - F.unix_micros(when.cast("timestamp"))) / 86_400_000_000).cast("int")


def prepare(docs: DataFrame) -> DataFrame:
    """Documents with what several operators need: title parts, body fields, scope, version key and content hash. An operator that
    is given these rows unwritten reads and computes just the columns that it uses."""
    return (
        docs.withColumn("content_hash", T.content_hash(F.col("content")))
        .withColumn("title_parts", T.title_parts(F.col("title")))
        .withColumn("base", F.col("title_parts.base"))
        .withColumn("lines_", T.field_lines(F.col("content")))
        .withColumn("pm", T.body_metadata(F.col("lines_")))
        .withColumn("scope", T.applicability(F.col("lines_")))
        .withColumn("version_key", T.version_key(F.col("title"), F.col("content")))
        .withColumn("body_clues", body_clues(F.col("content")))
        .drop("lines_")
    )


def age(docs: DataFrame, as_of: datetime, warning_days: int = schema.AGE_WARNING_DAYS, critical_days: int = schema.AGE_CRITICAL_DAYS) -> DataFrame:
    """A signal for a page without a date and for one of warning_days or critical_days."""
    rows = docs.select(F.col("id").alias("doc_id"), days_since(F.col("last_modified"), as_of).alias("n"))
    rows = rows.where(F.col("n").isNull() | (F.col("n") >= warning_days))
    critical = F.coalesce(F.col("n") >= critical_days, F.lit(False))
    limit = F.when(critical, critical_days).otherwise(warning_days)
    message = F.when(F.col("n").isNull(), "No last-modified date available").otherwise(F.format_string("Document is %d days old (threshold: %d)", "n", limit))
    found = schema.details(age_days=F.col("n"), threshold=F.when(F.col("n").isNotNull(), limit))
    return rows.select("doc_id", *_SIGNAL(AGE, F.array(F.lit(0)), "age", F.when(critical, "critical").otherwise("warning"), message, found))


def _newest(*more: str) -> Column:
    """The newest page of a group: by date, then the first fetched."""
    return F.max(F.struct(F.coalesce(F.unix_micros("last_modified"), F.lit(-(1 << 62))).alias("t"), (-F.col("doc_ord")).alias("o"), "id", "title", *more))


def duplicates(docs: DataFrame) -> DataFrame:
    """Every page but the newest of those with equal content; without dates the first fetched is kept.

    The newest is aggregated before the join, so a group of copies of any size meets one row."""
    newest = docs.groupBy("content_hash").agg(_newest().alias("new"), F.count("*").alias("n")).where("n > 1").select("content_hash", "new")
    rows = docs.select("id", "doc_ord", "content_hash").join(newest, "content_hash").where(F.col("doc_ord") != -F.col("new.o"))
    found = schema.details(duplicate_of=F.col("new.id"), duplicate_title=F.col("new.title"), similarity=F.lit(100.0))
    return rows.select(F.col("id").alias("doc_id"), *_SIGNAL(SIMILARITY, F.array(F.lit(0), F.col("doc_ord")), "duplicate", "critical", F.format_string("Exact duplicate of '%s'", "new.title"), found))


def version_markers(docs: DataFrame, duplicate: DataFrame) -> DataFrame:
    """Pages whose version is below the highest of their base title, unless they are exact duplicates."""
    rows = docs.where("version_key is not null").select("id", "doc_ord", "base", "title", "version_key")
    best = rows.groupBy("base").agg(F.max(F.struct("version_key", (-F.col("doc_ord")).alias("o"), "id", "title")).alias("top"))
    rows = rows.join(best, "base").where(F.col("version_key") < F.col("top.version_key"))
    rows = rows.join(duplicate.select(F.col("doc_id").alias("id")).distinct(), "id", "left_anti")
    dotted = lambda c: F.concat(F.lit("v"), F.array_join(F.col(c).cast("array<string>"), "."))
    rows = rows.select("id", "doc_ord", "top", dotted("version_key").alias("own"), dotted("top.version_key").alias("high"))
    found = schema.details(found_version=F.col("own"), current_version=F.col("high"), current_doc_id=F.col("top.id"), current_doc_title=F.col("top.title"), similar_to=F.col("top.id"), similar_title=F.col("top.title"))
    message = F.format_string("Contains version %s, but %s exists in '%s'", "own", "high", "top.title")
    return rows.select(F.col("id").alias("doc_id"), *_SIGNAL(SIMILARITY, F.array(F.lit(1), F.col("doc_ord")), "version_marker", "critical", message, found))


BLOCK = 128
_PART = 1024  # classes of a part of the pairing
#: All parts meet all parts, a task for two of them; with more classes parts become larger.
MAX_PARTS = 128
_TELLING = 12  # characters whose counts vary most order the classes


def _blocks(classes: DataFrame) -> tuple[DataFrame, int]:
    """(blocks as BLOCK_ROW, written; number of classes): classes that are alike in length and in the characters they have stand together."""

    def counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, squares = 0, np.zeros(3 * BINS), np.zeros(3 * BINS)
        for pdf in batches:
            bags = np.frombuffer(b"".join(pdf["bags"]), "<i2").reshape(len(pdf), -1).astype(float)
            n, sums, squares = n + len(pdf), sums + bags.sum(axis=0), squares + (bags * bags).sum(axis=0)
        yield pd.DataFrame({"n": [n], "sums": [sums], "squares": [squares]})

    parts = classes.select("p.bags").mapInPandas(counted, "n long, sums array<double>, squares array<double>")
    each = parts.select("n", F.posexplode(F.arrays_zip("sums", "squares")).alias("k", "x")).groupBy("k")
    found = each.agg(F.sum("n").alias("n"), F.sum("x.sums").alias("s"), F.sum("x.squares").alias("q")).orderBy("k").collect()  # a row a character and window
    n = int(found[0].n) if found else 0
    mean = np.array([r.s for r in found] or [0.0] * 3 * BINS) / max(n, 1)
    varies = np.array([r.q for r in found] or [0.0] * 3 * BINS) / max(n, 1) - mean**2
    telling = np.argsort(-varies[:BINS], kind="stable")[:_TELLING]

    @F.pandas_udf("int")
    def kind(bags: pd.Series) -> pd.Series:
        counts = np.frombuffer(b"".join(bags), "<i2").reshape(len(bags), -1)[:, telling]
        return pd.Series((counts > mean[telling]) @ (1 << np.arange(_TELLING)[::-1]), dtype="int32")

    def packed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, part = None, TaskContext.get().partitionId() << 32
        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf])
            while len(rest) >= BLOCK:
                yield pd.DataFrame([block_row(part, rest[:BLOCK])])
                rest, part = rest[BLOCK:], part + 1
        if rest is not None and len(rest):
            yield pd.DataFrame([block_row(part, rest)])

    size = F.floor(F.log1p(F.aggregate("p.lengths", F.lit(0), lambda s, x: s + x).cast("double")) * 12)
    rows = classes.select("id", "t", "o", "p.*", size.alias("size_"), kind("p.bags").alias("kind_"))
    rows = rows.repartitionByRange("size_", "kind_", "id").sortWithinPartitions("size_", "kind_", "id").drop("size_", "kind_")
    with batches_of(classes.sparkSession, BLOCK):
        return written(rows.mapInPandas(packed, BLOCK_ROW), "near-blocks"), n


def _block_pairs(blocks: DataFrame, classes: int) -> DataFrame:
    """Each two blocks, and each block with itself, in one row, the other's columns with `other_` before.

    Blocks are dealt to parts once, and each task reads two parts: no block is written down for each block that it meets, so disk does not
    grow with the pairs. Of the two tasks that see two blocks in either order one takes them, by turns."""
    parts = max(1, min(MAX_PARTS, max(-(-classes // _PART), min(4, -(-classes // BLOCK)))))
    dealt = blocks.repartition(parts)
    other = dealt.select([F.col(c).alias(f"other_{c}") for c in dealt.columns]).hint("shuffle_replicate_nl")
    turn = F.when((F.col("at") + F.col("other_at")) % 2 == 0, F.col("at") <= F.col("other_at")).otherwise(F.col("at") > F.col("other_at"))
    return dealt.join(other, turn)


def near_duplicates(docs: DataFrame, threshold: float = schema.SIMILARITY_THRESHOLD) -> DataFrame:
    """The older page of each pair of different contents whose similarity reaches the threshold.

    Pages of equal content are one class and its newest page stands for it. Classes are packed to blocks of alike ones, and all blocks meet.
    A block's envelope is the least and greatest length and count of each character; two blocks whose envelopes cannot reach the threshold
    are passed over. Of the others, pairs of classes are dropped where lengths, characters in common or what is in order among some of the
    characters rule the threshold out, and the rest are scored, so no pair is missed. The work is quadratic in the classes of like length and
    language; disk and memory are not. A page's rows stand together, the one that names its newest counterpart last."""
    newest = docs.groupBy("content_hash").agg(_newest("content").alias("r"))
    classes = written(newest.select("r.id", "r.t", "r.o", "r.title", profiled("r.content").alias("p")), "near-classes")
    blocks, n = _blocks(classes.drop("title"))
    with batches_of(docs.sparkSession, 4):  # two blocks are a megabyte or more
        rows = written(_block_pairs(blocks, n).mapInPandas(close_pairs(threshold * 100), PAIR), "near-pairs")
    rows = rows.join(classes.select(F.col("id").alias("head"), "title"), "head")
    rows = rows.repartition("id").sortWithinPartitions("id", "head_t", "head_o")
    found = schema.details(similar_to=F.col("head"), similar_title=F.col("title"), similarity=F.col("rounded"))
    order = F.array(F.lit(2), F.least(-F.col("o"), -F.col("head_o")), F.greatest(-F.col("o"), -F.col("head_o")))
    return rows.select(F.col("id").alias("doc_id"), *_SIGNAL(SIMILARITY, order, "near_duplicate", "warning", F.format_string("~%s%% similar to '%s'", "whole", "title"), found))


# Wordings before a version that make it a historical one.
_HISTORICAL = T.rx(r"(?:migrat\w+\s+from|upgrad\w+\s+from|previously|formerly|deprecated|replaced\s+by|instead\s+of|no\s+longer|was\s+in|changed\s+from|prior\s+to|before)\s+")


def version_refs(docs: DataFrame, current: dict[str, str], patterns: tuple[str, ...] = (r"v\d+\.\d+(\.\d+)?",)) -> DataFrame | None:
    """Versions other than the current one of a label that stands near them, but not behind historical wording."""
    if not current:
        return None
    frames = []
    for li, (label, now) in enumerate(current.items()):
        for pi, pattern in enumerate(patterns):
            p = T.rx(f"(?:{pattern})", fold=False)
            named = T.all_found(F.col("content"), p, 0)
            # the pieces between matches give each match's place
            places = F.aggregate(F.arrays_zip(named.alias("v"), F.split("content", p).alias("g")), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<v:string,at:int>>").alias("out")), lambda s, x: F.struct((s["at"] + F.length(F.coalesce(x["g"], F.lit(""))) + F.length(F.coalesce(x["v"], F.lit("")))).alias("at"), F.when(x["v"].isNull(), s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(x["v"].alias("v"), (s["at"] + F.length(F.coalesce(x["g"], F.lit("")))).alias("at"))))).alias("out")), lambda s: s["out"])
            rows = docs.where(F.col("content").rlike(p)).select("id", "content", F.posexplode(places).alias("k", "m")).where(F.col("m.v") != now)
            at, end = F.col("m.at"), F.col("m.at") + F.length("m.v")
            before = F.greatest(F.lit(0), at - 100)
            near = F.substring(F.lower("content"), before + 1, end + 50 - before)
            back = F.greatest(F.lit(0), at - 60)
            rows = rows.where(F.contains(near, F.lit(label.lower())) & ~T.strip(F.substring("content", back + 1, at - back)).rlike(_HISTORICAL))
            found = schema.details(label=F.lit(label), found_version=F.col("m.v"), current_version=F.lit(now))
            message = F.format_string("References '%s %s' but current version is '%s'", F.lit(label), "m.v", F.lit(now))
            frames.append(rows.select(F.col("id").alias("doc_id"), *_SIGNAL(VERSION_REFS, F.array(F.lit(li), F.lit(pi), F.col("k")), "version_ref", "warning", message, found)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def extracted_urls(docs: DataFrame) -> DataFrame:
    """(doc_id, k, url) of every public web address of a page."""
    rows = docs.select(F.col("id").alias("doc_id"), F.posexplode(T.urls(F.col("content"), F.col("metadata_links"))).alias("k", "url"))
    return rows.where(~private_host("url"))


def broken_links(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """Links whose probe answered 400 or more or did not connect. probes: (url, status_code, error), one row a URL."""
    bad = probes.where((F.col("status_code") >= 400) | (F.col("error") == "connection_failed"))
    rows = extracted_urls(docs).join(bad.select("url", "status_code", "error"), "url")
    message = F.format_string("Broken link (%s): %s", F.coalesce(F.col("status_code").cast("string"), "error"), "url")
    found = schema.details(url=F.col("url"), status_code=F.col("status_code"), error=F.col("error"))
    return rows.select("doc_id", *_SIGNAL(WEB_LINKS, F.array("k"), "broken_link", "warning", message, found))


#: A reference that matches at most so many pages lists them; of a larger class it names the class and the number, and matching_pages has the rest.
LISTED = 256
_PAGE = "array<struct<doc_ord:bigint,id:string,title:string>>"


def _classes(docs: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """(key, n, first, second, listed) of the pages of each key that is asked for: their number, the first two, and all of them up to LISTED + 1.

    One row a key, whatever number of pages has it: what is joined to references does not grow with a class."""
    page = F.struct("doc_ord", "id", "title")
    rows = docs.select(key.alias("key"), page.alias("d")).where("key is not null").join(wanted.where("key is not null").distinct(), "key", "left_semi")
    rows = written(rows, "class-members")
    first = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("d").alias("first"))
    # the second is the least that is not the first; a hot key is reduced before it is joined
    later = rows.join(first.where("n > 1").select("key", "first"), "key").where("d.id <> first.id").groupBy("key").agg(F.min("d").alias("second"))
    small = first.where(f"n between 2 and {LISTED + 1}").select("key")
    lists = rows.join(small, "key", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list("d")).alias("listed"))
    return first.join(later, "key", "left").join(lists, "key", "left")


def _cascade(rows: DataFrame, docs: DataFrame, steps: list[tuple[str, Column, Column]]) -> DataFrame:
    """rows with the first step (name, key of rows, key of docs) that leads to other pages than the row's own: `step`, `key`, `n` of these pages,
    `one` if it is one, `listed` if they are few. rows have own_<name>, the key of docs of their own page."""
    hits = []
    for name, mine, theirs in steps:
        rows = rows.withColumn(f"key_{name}", mine)
        found = _classes(docs, theirs, rows.select(F.col(f"key_{name}").alias("key")))
        rows = rows.join(found.select(F.col("key").alias(f"key_{name}"), F.struct("n", "first", "second", "listed").alias(f"class_{name}")), f"key_{name}", "left")
        c, own = F.col(f"class_{name}"), F.coalesce(F.col(f"key_{name}") == F.col(f"own_{name}"), F.lit(False))
        others = F.filter(c["listed"], lambda d: d["id"] != F.col("id"))
        n = c["n"] - own.cast("int")
        one = F.when(n == 1, F.when(own & (c["first"]["id"] == F.col("id")), c["second"]).otherwise(c["first"]))
        hits.append(F.when(n > 0, F.struct(F.lit(name).alias("step"), F.col(f"key_{name}").alias("key"), n.cast("int").alias("n"), one.alias("one"), others.alias("listed"))))
    rows = rows.withColumn("hit", F.coalesce(*hits))
    rows = rows.drop(*[f"{p}_{name}" for name, *_ in steps for p in ("key", "class", "own")])
    return rows.select("*", "hit.step", "hit.key", F.coalesce("hit.n", F.lit(0)).alias("n"), "hit.one", "hit.listed").drop("hit")


def _matching() -> dict[str, Column]:
    """The details of a row of _cascade that matches several pages."""
    several, large = F.col("n") > 1, (F.col("n") > 1) & F.col("listed").isNull()
    return {
        "matching_doc_ids": F.when(several, F.col("listed.id")), "matching_titles": F.when(several, F.col("listed.title")),
        "matching_class": F.when(large, F.concat_ws(":", "step", "key")), "matching_count": F.when(large, F.col("n")),
    }


def _page_keys(docs: DataFrame) -> dict[str, Column]:
    """The keys that references (exact, base) and links (id, url, title, base) look pages up by."""
    slash = lambda c: F.regexp_replace(c, "/+$", "")
    return {"exact": F.lower("title"), "base": F.col("base"), "id": F.col("id"), "url": slash(F.nullif(F.col("url"), F.lit(""))), "title": F.lower("title")}


def matching_pages(signals: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, analyzer_ord, sig_ord, match_id, match_title): each page that a signal matches if it matches several, of large classes too."""
    listed = signals.select("doc_id", "analyzer_ord", "sig_ord", F.explode(F.arrays_zip("details.matching_doc_ids", "details.matching_titles")).alias("m"))
    listed = listed.select("doc_id", "analyzer_ord", "sig_ord", F.col("m.matching_doc_ids").alias("match_id"), F.col("m.matching_titles").alias("match_title"))
    named = signals.where("details.matching_class is not null").select("doc_id", "analyzer_ord", "sig_ord", F.col("details.matching_class").alias("class"))
    keys = [F.concat_ws(":", F.lit(name), key) for name, key in _page_keys(docs).items()]
    pages = docs.select(F.col("id").alias("match_id"), F.col("title").alias("match_title"), F.explode(F.array(*keys)).alias("class"))
    pages = pages.join(named.select("class").distinct(), "class", "left_semi")
    return listed.unionByName(named.join(pages, "class").where("match_id <> doc_id").drop("class"))


def references(docs: DataFrame) -> DataFrame:
    """Titles that a page refers to: found once, several times or not at all among the pages of the scan."""
    keys = _page_keys(docs)
    rows = docs.select("id", keys["exact"].alias("own_exact"), keys["base"].alias("own_base"), F.posexplode(T.references(F.col("content"))).alias("k", "ref")).withColumn("norm", T.base_title(F.col("ref")))
    rows = written(rows, "references")  # texts are read once, and what is joined are titles
    rows = _cascade(rows, docs, [("exact", F.lower("ref"), keys["exact"]), ("base", F.col("norm"), keys["base"])])
    n, one = F.col("n"), F.col("one")
    variant = F.col("step") == "base"
    kind = F.when(n == 1, "resolved_reference").when(n > 1, "ambiguous_reference").otherwise("unresolved_reference")
    message = (
        F.when(n == 1, F.concat(F.format_string("References '%s' → '%s'", "ref", one["title"]), F.when(variant, " (matched by base title)").otherwise("")))
        .when(n > 1, F.format_string("References '%s' which matches %d documents", "ref", n))
        .otherwise(F.format_string("References '%s' but no matching page found among the pages in this scan", "ref"))
    )
    loose = (n != 1) | variant
    found = schema.details(
        referenced_title=F.col("ref"), resolved_doc_id=one["id"], resolved_title=one["title"],
        normalized_reference=F.when(loose, F.col("norm")), match_type=F.when((n == 1) & variant, "base_title_variant"), resolution_scope=F.when(loose, "scan_scope"), **_matching(),
    )
    return rows.select(F.col("id").alias("doc_id"), *_SIGNAL(REFERENCES, F.array("k"), kind, F.when(n == 1, "info").otherwise("warning"), message, found))


# Wordings of links to a successor and to a predecessor.
_REPLACEMENT = T.rx(r"\b(?:replaced?\s+by|superseded?\s+by|use\s+instead|moved?\s+to|see\s+(?:the\s+)?(?:new|current)\s+version|new\s+version(?:\s+is)?)\b")
_BACKLINK = T.rx(r"\b(?:migration\s+from|migrat(?:e[ds]?|ing)\s+from|upgrade\s+from|previous\s+version|legacy\s+version|from\s+the\s+old)\b")


def internal_links(docs: DataFrame) -> DataFrame:
    """Structured links: to one page (a replacement, a predecessor or plain), to several, or to none though they look internal."""
    keys = _page_keys(docs)
    rows = docs.select("id", F.col("url").alias("page"), *[keys[k].alias(f"own_{k}") for k in ("id", "url", "title", "base")], F.posexplode("links").alias("k", "l"))
    some = lambda c: F.nullif(c, F.lit(""))
    rows = rows.select("id", "page", "k", *[c for c in rows.columns if c.startswith("own_")], *[some(F.col(f"l.{f}")).alias(f) for f in ("url", "target_id", "target_title", "text", "context")])
    rows = written(rows, "links")
    rows = _cascade(rows, docs, [
        ("id", F.col("target_id"), keys["id"]), ("url", F.regexp_replace("url", "/+$", ""), keys["url"]),
        ("title", F.lower("target_title"), keys["title"]), ("base", T.base_title(F.col("target_title")), keys["base"]),
    ])
    n, one = F.col("n"), F.col("one")
    same_site = F.coalesce((host(F.col("url")) == host(F.col("page"))) & (host(F.col("url")) != ""), F.lit(False))
    rows = rows.where((n > 0) | F.col("target_id").isNotNull() | F.col("target_title").isNotNull() | same_site)
    said = F.concat_ws(" ", "text", "context")
    kind = F.when(n == 0, "broken_internal_link").when(n > 1, "ambiguous_internal_link").when(said.rlike(_REPLACEMENT), "replacement_link").when(said.rlike(_BACKLINK), "backlink_from_successor").otherwise("resolved_internal_link")
    rows = rows.withColumn("kind", kind)
    ref = F.coalesce("url", "target_title", "target_id", F.lit(""))
    k = F.col("kind")
    message = (
        F.when(k == "broken_internal_link", F.format_string("Internal link '%s' cannot be resolved to any document in this scan", ref))
        .when(k == "ambiguous_internal_link", F.format_string("Internal link '%s' matches %d documents", ref, n))
        .when(k == "replacement_link", F.format_string("Link to '%s' uses replacement language: this document is being replaced", one["title"]))
        .when(k == "backlink_from_successor", F.format_string("Link to '%s' references a previous/legacy version", one["title"]))
        .otherwise(F.format_string("Internal link → '%s'", one["title"]))
    )
    worded = k.isin("replacement_link", "backlink_from_successor")
    found = schema.details(
        url=F.coalesce("url", F.lit("")), target_id=F.when(n == 1, one["id"]), target_title=F.when(n == 1, one["title"]).when(n == 0, F.coalesce("target_title", F.lit(""))),
        link_text=F.when(worded, F.coalesce("text", F.lit(""))), **_matching(),
    )
    severity = F.when(k == "replacement_link", "critical").when(k.isin("broken_internal_link", "ambiguous_internal_link"), "warning").otherwise("info")
    return rows.select(F.col("id").alias("doc_id"), *_SIGNAL(INTERNAL_LINKS, F.array("k"), k, severity, message, found))


def edges(signals: DataFrame) -> DataFrame:
    """(source, target, kind) of resolved references and internal links between different pages."""
    target = F.coalesce("details.resolved_doc_id", "details.target_id")
    rows = signals.where(F.col("signal_type").isin("resolved_reference", "resolved_internal_link"))
    return rows.select(F.col("doc_id").alias("source"), target.alias("target"), F.col("signal_type").alias("kind")).where("source <> target").distinct()


def incoming_counts(signals: DataFrame) -> DataFrame:
    """(doc_id, incoming): from how many pages resolved references or internal links lead to a page."""
    return edges(signals).select("source", "target").distinct().groupBy(F.col("target").alias("doc_id")).agg(F.count("*").cast("int").alias("incoming"))


def superseded(docs: DataFrame) -> DataFrame:
    """(doc_id, reason): pages of which the scan has a newer sibling of the same base title.

    A stale mark names the first sibling. A year or version names the first sibling that is newer and whose scope does not
    say that both hold."""
    p = F.col("title_parts")
    year = F.when(p["version"].rlike(r"^\d{4}$"), p["version"].try_cast("int"))
    numbers = F.when(year.isNull(), F.transform(F.regexp_extract_all(p["version"], F.lit(r"(?U)\d+"), F.lit(0)), lambda n: n.try_cast("decimal(38,0)")))
    rows = docs.select("id", "doc_ord", "title", "base", p["version"].alias("v"), p["stale"].alias("mark"), year.alias("year"), numbers.alias("numbers"), F.map_entries("scope").alias("scope"))
    rows = written(rows, "siblings")
    # a page's first sibling: the family's first page, or for that page the next one
    member = F.struct("doc_ord", "id", "title")
    first = rows.groupBy("base").agg(F.min(member).alias("first"))
    second = rows.join(first, "base").where("id <> first.id").groupBy("base").agg(F.min(member).alias("second"))
    marked = rows.where("mark is not null").join(first, "base").join(second, "base")
    sibling = F.when(F.col("id") == F.col("first.id"), F.col("second.title")).otherwise(F.col("first.title"))
    marked = marked.select(F.col("id").alias("doc_id"), F.format_string("Title has stale suffix '%s' and a newer page '%s' exists in this scan", "mark", sibling).alias("reason"))
    # pages of one version and scope are alike, so classes are compared and not pages
    kinds = rows.where("v is not null").groupBy("base", "v", "year", "numbers", "scope").agg(F.min(F.struct("doc_ord", "title")).alias("d"))
    a, b = kinds.alias("a"), kinds.alias("b")
    newer = F.coalesce(F.col("b.year") > F.col("a.year"), F.lit(False)) | F.coalesce((F.size("a.numbers") > 0) & (F.size("b.numbers") > 0) & (F.col("b.numbers") > F.col("a.numbers")), F.lit(False))
    pairs = a.join(b, (F.col("a.base") == F.col("b.base")) & newer).where(~T.coexist(F.map_from_entries("a.scope"), F.map_from_entries("b.scope")))
    best = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in ("base", "v", "scope")]).agg(F.min(F.struct("b.d.doc_ord", "b.d.title", F.col("b.v").alias("v"))).alias("s"))
    older = rows.where("mark is null and v is not null").join(best, ["base", "v", "scope"])
    word = F.when(F.col("year").isNotNull(), "year").otherwise("version")
    return marked.union(older.select(F.col("id").alias("doc_id"), F.format_string("Superseded by a related page in this scan: '%s' (%s %s > %s)", "s.title", word, "s.v", "v")))


def grouped(signals: DataFrame) -> DataFrame:
    """(doc_id, signals): each page's signals in analyzer order."""
    row = F.struct("analyzer_ord", "sig_ord", "signal_type", "severity", "message", "details")
    rows = signals.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    return rows.select("doc_id", F.transform("s", lambda s: F.struct(*[s[c].alias(c) for c in ("signal_type", "severity", "message", "details")])).alias("signals"))
