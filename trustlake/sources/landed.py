"""Documents from landed API responses: wiki pages (Confluence) and workspace pages with their blocks (Notion).

A crawler lands each response's results as JSON lines; scopes (a space, a tree, a database, a title; see scopes.py) are then
filters and joins over the landed tables, and nothing is fetched from inside a Spark task. The order in which pages were landed is
the fetch order, which decides ties: `landed` has a row's file, the part of the file it was read from and its place in the reading task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trustlake.functions import text as T
from trustlake.functions.web import html_anchors, html_text
from trustlake.plans.numbering import numbered as numbers
from trustlake.plans.tables import shuffled, written
from trustlake.schema import LINK

WIKI_PAGE = (
    "id string, status string, title string, body struct<storage:struct<value:string>>, version struct<number:long,when:string,by:struct<displayName:string>>, "
    "history struct<createdDate:string,createdBy:struct<displayName:string>>, ancestors array<struct<id:string,title:string,space:struct<key:string>>>, space struct<key:string>, _links struct<webui:string>"
)
_RICH = "array<struct<plain_text:string,href:string,text:struct<link:struct<url:string>>>>"
#: A block's own data, whatever its type, is landed as `data`; position orders the children of one parent.
BLOCK = f"id string, parent_id string, position long, type string, has_children boolean, data struct<rich_text:{_RICH},cells:array<{_RICH}>,url:string,caption:{_RICH}>"
WORKSPACE_PAGE = (
    "id string, url string, last_edited_time string, created_time string, created_by struct<id:string>, last_edited_by struct<id:string>, parent struct<type:string,page_id:string,database_id:string>, archived boolean, "
    f"properties map<string,struct<type:string,title:array<struct<plain_text:string>>>>, child_page struct<title:string>"
)
MAX_DEPTH = 5


#: Where a row was landed; rows in the order of these columns are in fetch order.
LANDED = "struct<file:string,part:bigint,row:bigint>"


def read(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Landed rows of a layout with `landed`."""
    rows = spark.read.schema(layout).json(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("row"))
    return rows.select("*", place.alias("landed"))


def _time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def _shown(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def _landed(pages: DataFrame) -> list[str]:
    return ["landed"] if "landed" in pages.columns else []


# wiki


def in_space(pages: DataFrame, key: str) -> DataFrame:
    return pages.where(F.coalesce("space.key", F.get("ancestors", 0)["space"]["key"]) == key)


def in_tree(pages: DataFrame, root: str) -> DataFrame:
    """A page and the pages below it."""
    return pages.where((F.col("id") == root) | F.exists(F.coalesce("ancestors", F.array().cast(dict(pages.dtypes)["ancestors"])), lambda a: a["id"] == root))


def wiki_documents(pages: DataFrame, base_url: str) -> DataFrame:
    """Documents of wiki pages with a text, with `landed` if the pages have it; numbered gives them doc_ord."""
    html = F.coalesce("body.storage.value", F.lit(""))
    anchors = html_anchors(html, F.lit(base_url))
    rows = pages.withColumn("content", html_text(html)).where(_shown(F.col("content"))).withColumn("anchors", anchors)
    links = F.transform("anchors", lambda a: F.struct(a["href"].alias("url"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("target_title"), a["text"].alias("text"), a["context"].alias("context"), F.lit("confluence").alias("source")))
    metadata = F.to_json(F.struct(
        F.col("history.createdDate").alias("created_date"), F.col("history.createdBy.displayName").alias("created_by"), F.col("version.by.displayName").alias("last_edited_by"), F.col("version.number").alias("version_number"),
        F.col("status").alias("page_status"), F.coalesce("space.key", F.get("ancestors", 0)["space"]["key"]).alias("space_key"), F.col("ancestors.title").alias("ancestors"),
    ))
    webui = F.nullif(F.col("_links.webui"), F.lit(""))
    return rows.select(
        F.concat(F.lit("confluence-"), "id").alias("id"), F.coalesce("title", F.lit("Untitled")).alias("title"), "content", F.lit("confluence").alias("source_type"), F.concat(F.lit(base_url), webui).alias("url"),
        _time(F.col("version.when")).alias("last_modified"), F.lit(False).alias("archived"), metadata.alias("metadata"), F.col("anchors.href").alias("metadata_links"), links.alias("links"), *_landed(pages),
    )


# workspace


def page_id_of(url: Column) -> Column:
    """The page id in a workspace address, as 8-4-4-4-12 hexadecimal digits; null for other addresses."""
    digits = T.found(T.strip(url), T.rx(r"^https?://(?:www\.|app\.)?notion\.(?:so|com)/\S*?([0-9a-f]{32})(?:[?#]\S*)?$"))
    return F.regexp_replace(digits, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")


def page_title(pages: DataFrame) -> Column:
    own = F.get(F.filter(F.map_values("properties"), lambda p: p["type"] == "title"), 0)
    written_ = F.array_join(F.transform(own["title"], lambda t: F.coalesce(t["plain_text"], F.lit(""))), "")
    return F.when(own.isNotNull(), F.coalesce(written_, F.lit(""))).otherwise(F.coalesce("child_page.title", F.lit("Untitled")))


def _joined(rich: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(rich, lambda r: F.coalesce(r["plain_text"], F.lit(""))), ""), F.lit(""))


def block_text() -> Column:
    row = F.array_join(F.transform("data.cells", _joined), " | ")
    return F.when(F.size("data.rich_text") > 0, _joined(F.col("data.rich_text"))).when(F.col("type") == "table_row", F.coalesce(row, F.lit(""))).otherwise(F.lit(""))


def block_links() -> Column:
    text = F.nullif(block_text(), F.lit(""))

    def link(url: Column, said: Column, context: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(url.alias("url"), none.alias("target_id"), none.alias("target_title"), said.alias("text"), context.alias("context"), F.lit("notion").alias("source"))

    spans = F.transform(F.coalesce("data.rich_text", F.array().cast(_RICH)), lambda r: link(F.coalesce(F.nullif(r["href"], F.lit("")), r["text"]["link"]["url"]), F.nullif(T.strip(r["plain_text"]), F.lit("")), text))
    caption = F.coalesce(F.nullif(T.strip(_joined(F.col("data.caption"))), F.lit("")), F.col("data.url"))
    mark = F.when(F.col("type").isin("bookmark", "embed", "link_preview") & (F.col("data.url") != ""), F.array(link(F.col("data.url"), caption, caption))).otherwise(F.array().cast(f"array<{LINK}>"))
    return F.concat(F.filter(spans, lambda x: x["url"].isNotNull() & (x["url"] != "")), mark)


def page_blocks(pages: DataFrame, blocks: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(page_id, path, block_id, type, text, links) of the blocks of each page, to max_depth levels; what is below child pages and databases is not theirs."""
    level = pages.select(F.col("id").alias("page_id"), F.col("id").alias("block_id"), F.array().cast("array<bigint>").alias("path"))
    frames = []
    for _ in range(max_depth):
        level = written(level.join(shuffled(blocks), level.block_id == blocks.parent_id).select("page_id", blocks.id.alias("block_id"), "type", F.concat("path", F.array("position")).alias("path"), block_text().alias("text"), block_links().alias("links"), "has_children"), "blocks")
        frames.append(level.select("page_id", "path", "block_id", "type", "text", "links"))
        level = level.where("has_children").where(~F.col("type").isin("child_page", "child_database")).select("page_id", "block_id", "path")
        if not level.limit(1).count():
            break
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.union(f)
    return rows


def page_contents(pages: DataFrame, blocks: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(page_id, content, links): the blocks of each page in reading order, to max_depth levels, without child pages."""
    rows = page_blocks(pages, blocks.where(~F.col("type").isin("child_page", "child_database")), max_depth)
    row = F.struct("path", "text", "links")
    rows = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(row)).alias("b"))  # the blocks of one page
    return rows.select("page_id", F.array_join(F.filter(F.col("b.text"), lambda t: t != ""), "\n").alias("content"), F.flatten("b.links").alias("links"))


def in_database(pages: DataFrame, database: str) -> DataFrame:
    return pages.where(F.col("parent.database_id") == database)


def titled(pages: DataFrame, query: str) -> DataFrame:
    """Pages whose title has the query in it, whatever its case."""
    return pages.where(F.contains(F.lower(page_title(pages)), F.lit(query.lower())))


def below(pages: DataFrame, root: str, depth: int = 100) -> DataFrame:
    """The pages under a page or database, by their parents, to that depth."""
    children = pages.select("id", F.coalesce("parent.page_id", "parent.database_id").alias("up")).where("up is not null")
    children = written(children, "tree-parents")
    walk = f"""WITH RECURSIVE tree(id, depth) MAX RECURSION LEVEL {depth + 2} AS (
      SELECT id, 1 FROM {{children}} WHERE up = :root
      UNION ALL
      SELECT /*+ MERGE(c) */ c.id, t.depth + 1 FROM tree t JOIN {{children}} c ON c.up = t.id WHERE t.depth < {depth})
    SELECT DISTINCT id FROM tree"""
    spark, limit = pages.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "-1")  # a tree may have any number of pages
        found = written(spark.sql(walk, {"root": root}, children=children), "tree")
    finally:
        spark.conf.set(limit, before)
    return pages.join(shuffled(found), "id", "left_semi")


def same_title(pages: DataFrame, seed: str) -> DataFrame:
    """A page and all pages with its title key; an untitled page alone."""
    keyed = pages.withColumn("key", T.adapter_title(page_title(pages)))
    mine = keyed.where((F.col("id") == seed) & ~F.col("key").isin("", "untitled")).select("key").distinct()
    return keyed.join(F.broadcast(mine), "key", "left_semi").drop("key").unionByName(pages.where(F.col("id") == seed)).dropDuplicates(["id"])


def only_page(pages: DataFrame, title: str) -> str:
    """The id of the one page of a title."""
    found = [r.id for r in pages.where(F.lower(page_title(pages)) == title.lower()).select("id").limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{'several pages' if found else 'no page'} with the title {title!r}")
    return found[0]


def workspace_documents(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents of workspace pages with a text."""
    rows = pages.join(shuffled(page_contents(pages, blocks)), F.col("id") == F.col("page_id")).where(_shown(F.col("content")))
    metadata = F.to_json(F.struct("created_time", F.col("created_by.id").alias("created_by"), F.col("last_edited_by.id").alias("last_edited_by"), "parent"))
    return rows.select(
        "id", page_title(pages).alias("title"), "content", F.lit("notion").alias("source_type"), "url", _time(F.col("last_edited_time")).alias("last_modified"),
        F.coalesce("archived", F.lit(False)).alias("archived"), metadata.alias("metadata"), F.col("links.url").alias("metadata_links"), "links", *_landed(pages),
    )


def numbered(docs: DataFrame) -> DataFrame:
    """Documents with doc_ord: their places in the order in which they were landed, whatever the partitioning; for rows without `landed`, by id."""
    if "landed" not in docs.columns:
        return numbers(docs, [F.col("id")], "doc_ord")
    return numbers(docs, [F.col("landed"), F.col("id")], "doc_ord").drop("landed")
