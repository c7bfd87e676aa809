import duckdb
import pytest

from pagelake import catalog, fixtures
from pagelake.catalog import DESKTOP
from pagelake.kernels.css_selectors import parse_selectors
from pagelake.kernels.html_tree import dump, parse
from pagelake.operators import cascade, media, navigate
from pagelake.operators.select import select, select_by_kernel, select_from_pages
from pagelake.plans.corpus import Corpus
from pagelake.sources import pages as P
from pagelake.streaming import pages as streaming

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def nodes(spark):
    n = P.parse_nodes(spark.read.parquet(f"{SF}/pages.parquet")).cache()
    yield n
    n.unpersist()


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(6)
    return sorted(str(tuple(r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_like_sql(spark, database, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = database.sql(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


SELECTORS = ["li:nth-child(odd)", "article > h1", "p ~ p b", "li:first-child + li", "a:not([href^='/T'])", ":is(h1, h2), footer", "li:nth-child(2 of :not(:first-child))", "div:not(article div)", "b b:only-child", "html > body :last-of-type", "p:nth-last-of-type(2n+1)", "[class~=ad], li:nth-last-child(-n+2)", ":where(nav, footer) > *", "p:not(:is(article > p, q))", "*", "li:not(li + li) a", "b > b > b"]


@pytest.mark.parametrize("selector", SELECTORS)
def test_plan_and_kernel_select_the_same(spark, nodes, selector):
    a = [tuple(r) for r in select(nodes, selector).select("page_id", "node_id").collect()]
    b = [tuple(r) for r in select_by_kernel(spark.read.parquet(f"{SF}/pages.parquet"), selector).collect()]
    assert len(a) == len(set(a)) and set(a) == set(b)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    once = select_from_pages(pages, selector)
    assert once.columns == nodes.columns
    assert sorted(map(str, once.collect())) == sorted(map(str, select(nodes, selector).collect()))


def test_selectors_over_odd_pages(spark):
    html = "".join(h for h, _ in fixtures.TREES[:8]) + "<div id=A class='x Y'><p lang=en-US data-v='a b'><svg viewBox=1><linearGradient/></svg></div>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<x-y a=''>")], "page_id long, html string")
    n = P.parse_nodes(pages)
    for s in ("#A", "#a", ".x.Y", ".y", "[lang|=en]", "[lang|=EN]", "[data-v~=b]", "linearGradient", "LINEARGRADIENT", "svg > *", "[viewBox]", "DIV P", "x-y[a='']", ":empty", "td:only-child", "[a^='']"):
        a = {tuple(r) for r in select(n, s).select("page_id", "node_id").collect()}
        assert a == {tuple(r) for r in select_by_kernel(pages, s).collect()}, s
    for bad in ("p:unknown", "div >", "a|b", ""):
        assert parse_selectors(bad) is None
        with pytest.raises(ValueError):
            select(n, bad)


def test_dump_and_structure(spark, nodes):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["dump"] for r in navigate.dump(nodes).collect()}
    assert got == {r["page_id"]: dump(parse(r["html"]).doc) for r in pages}
    by_window = {(r["page_id"], r["node_id"]): tuple(r)[2:] for r in navigate.structure(nodes).collect()}
    by_kernel = {(r["page_id"], r["node_id"]): (r["elem_idx"], r["elem_count"], r["type_idx"], r["type_count"]) for r in nodes.where("kind = 'element'").collect()}
    assert by_window == by_kernel


def test_node_intervals_and_paths(nodes):
    rows = {(r["page_id"], r["node_id"]): r for r in nodes.collect()}
    for (page, node), r in rows.items():
        if r["parent_id"] is not None:
            up = rows[(page, r["parent_id"])]
            assert up["node_id"] < node <= up["last"] and r["path"] == [*up["path"], up["node_id"]]
            assert r["depth"] == len(r["path"])


def test_kernels_emit_wanted_columns_only(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    n = P.parse_nodes(pages, columns=["page_id", "name"])
    assert n.columns == ["page_id", "name"]
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan and "Exchange" not in plan


def test_media_natively_and_by_kernel(spark):
    rows = [(0, "screen", 1024.0, 768.0, 1024.0, 768.0, 1.0, 8, 16.0, DESKTOP.features), (1, "print", 300.0, 900.0, 300.0, 900.0, 2.0, 0, 16.0, {"hover": "none", "color-gamut": "p3"})]
    env = spark.createDataFrame(rows, media.ENVIRONMENT)
    texts = [q for q, _, _ in fixtures.MEDIA] + ["(min-width: 20em) and (max-aspect-ratio: 1/1)", "(color)", "print and (resolution >= 1.5dppx)", "not ((hover) or (color))", "(color-gamut: srgb)", "(width: calc(100px + 200px))"]
    got = {(r["env_id"], r["case_id"]): r["matches"] for r in media.match_media(env, texts).collect()}
    cases = spark.createDataFrame(list(enumerate(texts)), "case_id long, query string")
    for r in rows:
        e = media.Environment(r[1], *r[2:9], features=r[9])
        for m in media.media_by_kernel(cases, e).collect():
            assert got[(r[0], m["case_id"])] == m["matches"], texts[m["case_id"]]


def test_winner_order(spark):
    from pyspark.sql import functions as F

    rows = [("ua", False, False, False, False), ("author", True, False, False, False), ("inner", True, False, True, False), ("inline", True, False, False, True), ("author!", True, True, False, False), ("inner!", True, True, True, False), ("ua!", False, True, False, False)]
    d = spark.createDataFrame(rows, "value string, author boolean, important boolean, inner boolean, inline boolean")
    p = cascade.priority(F.col("author"), F.col("important"), F.col("inner"), F.col("inline"), F.struct(F.lit(0), F.lit(0), F.lit(0)), F.lit(0), F.lit(0))
    assert [r["value"] for r in d.orderBy(p).collect()] == ["ua", "inner", "author", "inline", "author!", "inner!", "ua!"]


def test_corpus_and_sql(spark):
    c = Corpus(spark.read.parquet(f"{SF}/pages.parquet").limit(5))
    assert c.select("nav li").count() == c.sql("SELECT * FROM nodes WHERE name = 'li'").count() > 0
    assert c.text("h1").count() == 5
    wide = c.wide_styles(["display", "font-size"], ["h1"]).collect()
    assert {(r["display"], r["font-size"]) for r in wide} == {("block", "32px")}
    assert spark.sql("SELECT name FROM pages, LATERAL html_nodes(html) n WHERE n.name = 'article'").count() == 5
    assert spark.sql("SELECT * FROM css_tokens('a{b:c}')").count() == 6
    assert c.sql("SELECT max(w) AS w FROM boxes WHERE tag = 'body'").first()["w"] == 1008.0


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages.repartition(3).write.parquet(source)
    rows = streaming.stream_nodes(streaming.stream_pages(spark, source, files_per_trigger=1), columns=["page_id", "node_id", "name"])
    streaming.write_parquet(rows, out, str(tmp_path / "ck")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == sorted(map(tuple, P.parse_nodes(pages, columns=["page_id", "node_id", "name"]).collect()), key=str)


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.columns == ["page_id", "w700", "w900"] and got.count() == 50
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
