"""Scopes, fetch order and the data source over landed responses."""

import json

import pytest
from pyspark.sql import functions as F

from trustlake.sources import landed, reader, scopes

ADDRESS = "https://www.notion.so/T-{}?v=1"
SEED = "abc123de-f456-abc1-23de-f456abc123de"


def page(id_, title, parent=None, kind="page_id"):
    shown = {"Name": {"type": "title", "title": [{"plain_text": title}]}}
    return {"id": id_, "url": f"u/{id_}", "last_edited_time": "2026-01-02T00:00:00Z", "properties": shown, "parent": {"type": kind, kind: parent} if parent else {"type": "workspace"}}


def text(page_id, said="Some text.", position=1, **more):
    return {"id": f"{page_id}-{position}", "parent_id": page_id, "position": position, "type": "paragraph", "has_children": False, "data": {"rich_text": [{"plain_text": said}]}} | more


def write(path, rows, files=1):
    path.mkdir()
    for k in range(files):
        (path / f"part-{k}.json").write_text("".join(json.dumps(r) + "\n" for r in rows[k * len(rows) // files : (k + 1) * len(rows) // files]))
    return str(path)


@pytest.fixture
def workspace(spark, tmp_path):
    def of(pages, blocks, **scope):
        p = landed.read(spark, write(tmp_path / f"p{len(list(tmp_path.iterdir()))}", pages), landed.WORKSPACE_PAGE)
        b = landed.read(spark, write(tmp_path / f"b{len(list(tmp_path.iterdir()))}", blocks), landed.BLOCK)
        docs = landed.numbered(landed.workspace_documents(scopes.workspace(p, b, **scope), b))
        return [r.id for r in docs.orderBy("doc_ord").collect()]

    return of


FAMILY = [page(SEED, "KB Page v3"), page("other", "Unrelated"), page("v2", "KB Page v2"), page("old", "kb page (old)"), page("blank", "KB Page v1")]


def test_an_address_leads_to_its_title_family(workspace):
    blocks = [text(p["id"]) for p in FAMILY if p["id"] != "blank"]
    assert workspace(FAMILY, blocks, query=ADDRESS.format(SEED.replace("-", ""))) == [SEED, "v2", "old"]


def test_an_address_without_page_title_or_text(workspace):
    missing = ADDRESS.format("0" * 32)
    assert workspace(FAMILY, [text(SEED)], query=missing) == []
    untitled = [page(SEED, "Untitled"), page("x", "Untitled")]
    assert workspace(untitled, [text(SEED), text("x")], query=ADDRESS.format(SEED.replace("-", ""))) == [SEED]
    node = [page(SEED, "Node"), page("child", "API Guide v2", SEED), page("outside", "API Guide v1"), page("else", "Node")]
    assert workspace(node, [text(p) for p in ("child", "outside", "else")], query=ADDRESS.format(SEED.replace("-", ""))) == ["child", "outside"]


def test_a_title_search_and_its_fallback_to_the_tree(workspace):
    pages = [page("parent", "Documentation"), page("a", "API Guide v2", "parent"), page("b", "Setup Notes", "a"), page("out", "API Guide v1"), page("else", "Billing"), page("more", "Documentation plan")]
    blocks = [text(p) for p in ("a", "b", "out", "else", "more")]
    assert workspace(pages, blocks, query="documentation") == ["a", "b", "out"]
    assert workspace(pages, [*blocks, text("parent")], query="documentation") == ["parent", "more"]
    assert workspace(pages, blocks, query="guide") == ["a", "out"]
    # of several exact titles the first landed decides
    twins = [page("first", "Twin"), page("second", "Twin"), page("kid", "Kid", "second")]
    assert workspace(twins, [text("first"), text("kid")], query="TWIN") == ["first"]
    assert workspace([twins[1], twins[0], twins[2]], [text("first"), text("kid")], query="TWIN") == ["kid"]


def test_a_tree_has_the_databases_in_its_texts(workspace):
    pages = [page("parent", "Docs"), page("kid", "Guide", "parent"), page("row1", "Entry", "db", "database_id"), page("row2", "Empty entry", "db", "database_id"), page("out", "Entry v9"), page("row3", "Elsewhere", "db2", "database_id")]
    toggle = text("kid", "toggle", 2, has_children=True)
    blocks = [text("kid"), toggle, text("kid-2", "", 1, id="db", type="child_database"), text("row1"), text("out"), text("row3"), text("db", "what is in a database is not the page's", 1)]
    assert workspace(pages, blocks, query="Docs") == ["kid", "row1", "out"]


def test_the_first_scope_that_is_given_decides(workspace):
    pages = [page("r", "Root"), page("k", "Kid", "r"), page("e", "Entry", "db", "database_id"), page("loop", "Loop", "loop"), page("x", "Alone")]
    blocks = [text(p["id"]) for p in pages]
    assert workspace(pages, blocks, query="alone", database="db", root="r") == ["x"]
    assert workspace(pages, blocks, database="db", root="r") == ["e"]
    assert workspace(pages, blocks, root="r") == ["r", "k"] and workspace(pages, blocks, root="loop") == ["loop"]
    assert workspace(pages, blocks) == ["r", "k", "e", "loop", "x"]


def test_deep_and_wide_trees(spark):
    rows = [(f"p{i}", f"p{i - 1}") for i in range(1, 90)] + [(f"w{i}", "p5") for i in range(3000)] + [("c1", "c2"), ("c2", "c1")]
    pages = spark.createDataFrame([(i, (None, up, None)) for i, up in rows], "id string, parent struct<type:string,page_id:string,database_id:string>")
    assert landed.below(pages, "p0").count() == 89 + 3000
    assert sorted(r.id for r in landed.below(pages, "c1", depth=7).collect()) == ["c1", "c2"]


WIKI = [
    {"id": str(i), "title": f"T{i}", "body": {"storage": {"value": f"<p>text {i}</p>"}}, "space": {"key": "ENG" if i % 2 else "OPS"} if i > 9 or i % 2 else None, "ancestors": [{"id": str(i // 10), "title": "A"}] if i > 9 else [{"id": "root", "space": {"key": "ENG"}}]} for i in range(60)
]


def test_wiki_scopes(spark, tmp_path):
    pages = landed.read(spark, write(tmp_path / "w", WIKI), landed.WIKI_PAGE)
    with pytest.raises(ValueError, match="needs"):
        scopes.wiki(pages)
    assert {r.id for r in scopes.wiki(pages, query="title like 'T1%'", page="3", space="OPS").collect()} == {"1", *(str(i) for i in range(10, 20))}
    assert {r.id for r in scopes.wiki(pages, page="3", space="OPS").collect()} == {"3", *(str(i) for i in range(30, 40))}
    assert scopes.wiki(pages, space="OPS").count() == 25 and scopes.wiki(pages, space="ENG").count() == 35


@pytest.mark.parametrize("files", [1, 7])
def test_pages_are_numbered_as_they_were_landed(spark, tmp_path, files):
    order = [WIKI[(i * 37) % 60] for i in range(60)]
    path = write(tmp_path / "w", order, files)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        docs = landed.numbered(landed.wiki_documents(landed.read(spark, path, landed.WIKI_PAGE).repartition(5), "https://w.example"))
        got = [(r.doc_ord, r.id) for r in docs.repartition(3).orderBy("doc_ord").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, f"confluence-{p['id']}") for i, p in enumerate(order)]
    assert "landed" not in docs.columns


def test_the_data_source_gives_what_sparks_reader_gives(spark, tmp_path):
    reader.register(spark)
    path = write(tmp_path / "w", WIKI, 3)
    (tmp_path / "w" / "part-9.json").write_text('not json\n[1]\n{"id": 77, "title": {"a": 1}, "space": {"key": "ENG"}, "version": {"number": "x"}, "ancestors": null}')
    read = spark.read.format("landed").option("path", path)
    for split in ("100", "5000000"):
        rows = read.option("split", split).option("space", "ENG").load()
        own = landed.in_space(landed.read(spark, path, landed.WIKI_PAGE), "ENG")
        got = {r.id: r.asDict(True) for r in rows.drop("landed").collect()}
        assert got.pop("77")["title"] == '{"a": 1}'
        expected = {r.id: r.asDict(True) for r in own.drop("landed").collect() if r.id != "77"}
        assert got == expected and len(got) == 35
    tree = read.option("page", "3").load()
    assert {r.id for r in tree.collect()} == {"3", *(str(i) for i in range(30, 40))}
    docs = landed.numbered(landed.wiki_documents(read.option("page", "3").option("split", "300").load(), "https://w.example"))
    assert [r.id for r in docs.orderBy("doc_ord").collect()] == [f"confluence-{i}" for i in (3, *range(30, 40))]


def test_the_data_source_tests_scopes_and_pushed_comparisons(spark, tmp_path):
    reader.register(spark)
    read = spark.read.format("landed").option("path", write(tmp_path / "w", WIKI))
    with pytest.raises(Exception, match="needs a page or a space"):
        read.load().collect()
    with pytest.raises(Exception, match="kind is one of"):
        read.option("kind", "other").load()
    rows = read.option("kind", "wiki").option("space", "ENG").load()
    some = rows.where((F.col("title") == "T11") | (F.col("title") == "T12")).where(F.col("space.key") == "ENG")
    assert [r.id for r in some.collect()] == ["11"]
    one = rows.where(F.col("space.key") == "ENG")
    assert one.count() == 30
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan landed" in plan and "= ENG" not in plan  # the reader has seen to it


def test_the_data_source_reads_workspaces(spark, tmp_path):
    reader.register(spark)
    path = write(tmp_path / "w", [page("e", "Entry", "db", "database_id"), page("x", "Alone")])
    read = spark.read.format("landed").option("path", path).option("kind", "workspace")
    assert [r.id for r in read.option("database", "db").load().collect()] == ["e"]
    titles = {r.t for r in read.option("database", "").load().select(landed.page_title(read.load()).alias("t")).collect()}
    assert titles == {"Entry", "Alone"}
