"""Which landed pages a scan looks at: a query, a database, a tree, a space or all.

The first scope that is given decides, in the order of the parameters. A workspace query is a page's address or a title:

- an address leads to its page and all pages of the same title key; to the page alone if it has no title; to the page's tree if it
  has no text; to nothing if there is no such page;
- a title leads to the pages that have it in theirs; if the first page of exactly this title has no text, to its tree.

A tree found in this way is the page, the pages below it, the entries of databases that stand in the texts of these, and then the pages outside that
share a title key with a page of the tree that has a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustlake.functions import text as T
from trustlake.plans.tables import shuffled, written
from trustlake.sources import landed as L


def wiki(pages: DataFrame, query: str | None = None, page: str | None = None, space: str | None = None) -> DataFrame:
    """The pages of a condition over landed columns (Spark SQL), of the tree of a page, or of a space."""
    if query:
        return pages.where(F.expr(query))
    if page:
        return L.in_tree(pages, page)
    if space:
        return L.in_space(pages, space)
    raise ValueError("a wiki scan needs a query, a page or a space")


def workspace(pages: DataFrame, blocks: DataFrame, query: str | None = None, database: str | None = None, root: str | None = None) -> DataFrame:
    """The pages of a query, of a database, of the tree of a page, or all."""
    if query:
        address = pages.sparkSession.range(1).select(L.page_id_of(F.lit(query))).first()[0]  # one row
        return by_address(pages, blocks, address.lower()) if address else by_title(pages, blocks, query)
    if database:
        return L.in_database(pages, database)
    if root:
        return page_tree(pages, root)
    return pages


def page_tree(pages: DataFrame, root: str) -> DataFrame:
    """A page, if it is one, and those below it."""
    return pages.where(F.col("id") == root).unionByName(L.below(pages, root).where(F.col("id") != root))


def _blank(pages: DataFrame, blocks: DataFrame, page: str) -> bool:
    content = L.page_contents(pages.where(F.col("id") == page), blocks)
    return not content.where(F.col("content").rlike(r"(?U)\S")).limit(1).count()


def by_address(pages: DataFrame, blocks: DataFrame, page: str) -> DataFrame:
    seed = pages.where(F.col("id") == page).select(L.page_title(pages).alias("title")).first()
    if seed is None:
        return pages.limit(0)
    if seed.title in ("", "Untitled"):
        return pages.where(F.col("id") == page)
    if _blank(pages, blocks, page):
        return related_tree(pages, blocks, page)
    key = T.adapter_title(L.page_title(pages))
    return pages.where((F.col("id") == page) | (key == T.adapter_title(F.lit(seed.title))))


def by_title(pages: DataFrame, blocks: DataFrame, title: str) -> DataFrame:
    order = F.col("landed") if "landed" in pages.columns else F.col("id")
    exact = pages.where(F.lower(L.page_title(pages)) == title.lower()).agg(F.min_by("id", order)).first()[0]
    if exact is not None and _blank(pages, blocks, exact):
        return related_tree(pages, blocks, exact)
    return L.titled(pages, title)


def related_tree(pages: DataFrame, blocks: DataFrame, root: str) -> DataFrame:
    """The tree of a page with databases in its texts, and the pages outside that share a title key with it."""
    tree = page_tree(pages, root)
    parts = written(L.page_blocks(tree, blocks), "tree-blocks")
    # pages with a text; a child page's or database's own line is none
    shown = parts.where(~F.col("type").isin("child_page", "child_database") & F.col("text").rlike(r"(?U)\S")).select(F.col("page_id").alias("id")).distinct()
    inline = parts.where("type = 'child_database'").select(F.col("block_id").alias("database")).distinct()
    entries = pages.join(shuffled(inline), F.col("parent.database_id") == F.col("database"), "left_semi")
    entries = entries.join(shuffled(L.page_contents(entries, blocks).where(F.col("content").rlike(r"(?U)\S")).select(F.col("page_id").alias("id"))), "id", "left_semi")
    seen = written(tree.select("id").join(shuffled(shown), "id", "left_semi").union(entries.select("id")).distinct(), "tree-seen")
    keyed = pages.select("id", T.adapter_title(L.page_title(pages)).alias("key"))
    keys = keyed.join(shuffled(seen), "id", "left_semi").select("key").distinct()
    related = keyed.join(shuffled(keys), "key", "left_semi").select("id").join(shuffled(seen), "id", "left_anti")
    return pages.join(shuffled(seen.union(related).distinct()), "id", "left_semi")
