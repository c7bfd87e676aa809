"""Queries of the library's own operators over the tables in a folder, and the same in SQL where SQL can say it.

Where a key ends in _cases, its SQL is the list of results that the standards give (pagelake.fixtures): a check against fixed values, not a
second computation. SQL that reads pages with regular expressions relies on how regular the table pages is: its tags are explicit, scripts
hold one stray `</p>`, b elements are never closed and stand first in their p.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import fixtures as X
from .functions import css as css_functions
from .kernels.css_media import Environment
from .kernels.css_selectors import Index, matches_host, parse_selectors
from .kernels.css_syntax import block_contents, parse_one_declaration, parse_rule, parse_rules, parse_values, preprocess, raw_declarations, to_css
from .kernels.css_values import compute_custom, substitute
from .kernels.font import Font
from .kernels.html_tree import Options, descendants as tree_nodes, dump, parse, parse_fragment
from .operators import cascade, fonts, media, navigate
from .operators.select import select, select_by_kernel, select_from_pages, specificities
from .session import flat_map
from .sources import pages as P

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}
DESKTOP = Environment()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages for a kernel. Where they stand in fewer splits than there are cores, as in one small file, they are dealt out; else they are read as they lie."""
    p = _table(spark, sf_dir, "pages").select("page_id", "html")
    cores = spark.sparkContext.defaultParallelism
    return p if p.rdd.getNumPartitions() >= cores else p.repartition(cores)


def query(name: str, sql: str | None = None):
    def register(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return register


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, float):
        return f"{v!r}::DOUBLE"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def _values(names: list[str], rows, casts: dict[str, str] | None = None) -> str:
    """SQL of a table of literals."""
    body = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    columns = ", ".join(f"{n}::{(casts or {}).get(n, 'VARCHAR')} AS {n}" if (casts or {}).get(n) else n for n in names)
    return f"SELECT {columns} FROM (VALUES {body}) t({', '.join(names)})"


# sources and the lexer


@query(
    "o_i01_tag_counts",
    """SELECT page_id, len(regexp_extract_all(html, '<h1>'))::BIGINT AS h1, len(regexp_extract_all(html, '<li>'))::BIGINT AS li, len(regexp_extract_all(html, '<a href'))::BIGINT AS a,
    len(regexp_extract_all(html, '<nav>'))::BIGINT AS nav, len(regexp_extract_all(html, '<article>'))::BIGINT AS article, len(regexp_extract_all(html, '<footer>'))::BIGINT AS footer FROM pages""",
)
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_pages(spark, sf_dir), columns=["page_id", "name"])
    return n.groupBy("page_id").agg(*[F.count_if(F.col("name") == t).alias(t) for t in ("h1", "li", "a", "nav", "article", "footer")])


@query("o_i02_scripting_noscript", "SELECT page_id, 0::BIGINT AS elements_below FROM pages")
def scripting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With scripting on, what stands in noscript is text; no page has any element there."""
    p = _pages(spark, sf_dir)
    n = P.parse_nodes(p, Options(scripting=True))
    below = select(n, "noscript *").groupBy("page_id").count()
    return p.select("page_id").join(below, "page_id", "left").select("page_id", F.coalesce("count", F.lit(0)).cast("bigint").alias("elements_below"))


@query("o_i04_fragment_cases", _values(["case_id", "dump"], [(i, c[3]) for i, c in enumerate(X.FRAGMENTS)], {"case_id": "BIGINT"}))
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(X.FRAGMENTS)], "case_id long, ns string, context string, html string")
    return flat_map(cases, lambda i, ns, name, html: [(i, short_dump(parse_fragment(html, ns, name)))], "case_id long, dump string")


def short_dump(root) -> str:
    return "/".join(_outdent(x) for x in dump(root).replace("\n|", "\x00|").split("\x00"))


def _outdent(line: str) -> str:
    body = line[2:]
    inner = body.lstrip(" ")
    return " " * ((len(body) - len(inner)) // 2) + inner


@query("o_d03_tree_cases", _values(["case_id", "dump"], [(i, c[1]) for i, c in enumerate(X.TREES)], {"case_id": "BIGINT"}))
def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(i, c[0]) for i, c in enumerate(X.TREES)], "case_id long, html string")
    return flat_map(cases, lambda i, html: [(i, short_dump(parse(html).doc))], "case_id long, dump string")


@query("o_d07_shadow_cases", _values(["case_id", "dump"], [(i, c[1]) for i, c in enumerate(X.SHADOWS)], {"case_id": "BIGINT"}))
def shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(i, c[0]) for i, c in enumerate(X.SHADOWS)], "case_id long, html string")
    return flat_map(cases, lambda i, html: [(i, short_dump(parse(html, Options(declarative_shadow_roots=True)).doc))], "case_id long, dump string")


@query("o_t16_reference_cases", _values(["case_id", "as_text", "as_value"], [(i, *c[1:]) for i, c in enumerate(X.REFERENCES)], {"case_id": "BIGINT"}))
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(2 * i + k, (f"<p>{c[0]}", f'<p a="{c[0]}">')[k]) for i, c in enumerate(X.REFERENCES) for k in (0, 1)], "page_id long, html string")
    n = P.parse_nodes(cases)
    text = n.where("kind = 'text' AND page_id % 2 = 0").select(F.expr("page_id div 2").alias("case_id"), F.col("text").alias("as_text"))
    value = n.where("name = 'p' AND page_id % 2 = 1").select(F.expr("page_id div 2").alias("case_id"), F.element_at("attrs", "a").alias("as_value"))
    return text.join(value, "case_id")


@query(
    "o_t04_token_counts",
    """SELECT page_id, len(regexp_extract_all(html, '<[a-zA-Z][^>]*>'))::BIGINT AS starts, len(regexp_extract_all(html, '</[a-zA-Z][^>]*>'))::BIGINT AS ends,
    len(regexp_extract_all(html, '<!--'))::BIGINT AS comments, 1::BIGINT AS doctypes FROM pages""",
)
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.tokenize(_pages(spark, sf_dir), columns=["page_id", "kind"])
    return t.groupBy("page_id").agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("start", "starts"), ("end", "ends"), ("comment", "comments"), ("doctype", "doctypes"))])


@query("o_i05_lateral_tokens", "SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS li_tags FROM pages")
def lateral_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.corpus import register_functions

    register_functions(spark)
    _pages(spark, sf_dir).createOrReplaceTempView("_lateral_pages")
    return spark.sql("SELECT page_id, count_if(t.kind = 'start' AND t.name = 'li') AS li_tags FROM _lateral_pages, LATERAL tokenize_html(html) t GROUP BY page_id")


@query("o_t02_newlines", "SELECT page_id, length(regexp_replace(html, '\r\n?', chr(10), 'g'))::BIGINT AS n, (length(html) - length(replace(html, chr(10), '')))::BIGINT AS feeds FROM pages")
def newline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    fixed = css_functions.html_newlines(F.col("html"))
    return p.select("page_id", F.length(fixed).cast("bigint").alias("n"), (F.length("html") - F.length(F.replace("html", F.lit("\n"), F.lit("")))).cast("bigint").alias("feeds"))


@query("o_i06_preprocess", "SELECT doc_id, md5(replace(regexp_replace(text, '\r\n?|\f', chr(10), 'g'), chr(0), chr(65533))) AS digest FROM documents")
def preprocess_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(css_functions.preprocess_css(F.col("text")).cast("binary")).alias("digest"))


_DECODE = "replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&'), '&amp', '&')"


@query("o_t07_hrefs", f"SELECT page_id, u.ord::BIGINT AS ord, {_DECODE.format('u.href')} AS href FROM pages, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) WITH ORDINALITY u(href, ord)")
def hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_pages(spark, sf_dir), columns=["page_id", "node_id", "name", "attrs"]).where("name = 'a'")
    w = Window.partitionBy("page_id").orderBy("node_id")
    return n.select("page_id", F.row_number().over(w).cast("bigint").alias("ord"), F.element_at("attrs", "href").alias("href"))


def _text_sql(tag: str) -> str:
    return f"SELECT page_id, {_DECODE.format(f'''regexp_extract(html, '<{tag}>((?s:.*?))</{tag}>', 1)''')} AS text FROM pages"


@query("o_t16_title_text", _text_sql("title"))
def title_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_pages(spark, sf_dir))
    return navigate.text_content(n, navigate.elements(n, "title")).select("page_id", "text")


@query("o_t16_h1_text", _text_sql("h1"))
def h1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_pages(spark, sf_dir))
    return navigate.text_content(n, select(n, "article > h1")).select("page_id", "text")


@query("o_t13_comments", "SELECT page_id, u.ord::BIGINT AS ord, u.text AS text FROM pages, unnest(regexp_extract_all(html, '<!--((?s:.*?))-->', 1)) WITH ORDINALITY u(text, ord)")
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = P.tokenize(_pages(spark, sf_dir), columns=["page_id", "pos", "kind", "data"]).where("kind = 'comment'")
    return t.select("page_id", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("bigint").alias("ord"), F.col("data").alias("text"))


@query("o_d10_p_counts", "SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS p FROM pages")
def p_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_pages(spark, sf_dir), columns=["page_id", "name"])
    return n.groupBy("page_id").agg(F.count_if(F.col("name") == "p").alias("p"))


# b elements of each p: those of the active list that are opened again, and its own
_B_MODEL = """
WITH ps AS (SELECT page_id, u.ord, starts_with(u.body, '<p><b>') AS own FROM pages, unnest(regexp_extract_all(html, '<p>(?:<b>)?')) WITH ORDINALITY u(body, ord)),
k AS (SELECT *, sum(own::INT) OVER (PARTITION BY page_id ORDER BY ord) AS k FROM ps),
d AS (SELECT page_id, CASE WHEN own THEN least(k - 1, 3) + 1 ELSE least(k, 3) END AS depth FROM k
      UNION ALL SELECT page_id, least(max(k), 3) FROM k GROUP BY page_id),
e AS (SELECT page_id, depth, unnest(range(1, depth::BIGINT + 1)) AS level FROM d WHERE depth > 0)"""


@query("o_d14_b_counts", _B_MODEL + " SELECT page_id, count(*) AS b FROM e GROUP BY page_id")
def b_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_nodes(_pages(spark, sf_dir), columns=["page_id", "name"]).where("name = 'b'").groupBy("page_id").agg(F.count("*").alias("b"))


@query("o_s13_b_weights", _B_MODEL + " SELECT CASE WHEN level = 1 THEN 700.0 ELSE 900.0 END::DOUBLE AS weight, count(*) AS n FROM e GROUP BY 1")
def b_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed font-weight of b elements: 700 for the outermost, 900 inside."""
    return P.compute_styles(_pages(spark, sf_dir), properties=["font-weight"], tags=["b"]).groupBy(F.col("num").alias("weight")).agg(F.count("*").alias("n"))


@query("o_s13_b_weights_by_page", _B_MODEL + " SELECT page_id, count(*) FILTER (level = 1) AS w700, count(*) FILTER (level > 1) AS w900 FROM e GROUP BY page_id")
def b_weights_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.compute_styles(_pages(spark, sf_dir), properties=["font-weight"], tags=["b"])
    return s.groupBy("page_id").agg(F.count_if(F.col("num") == 700).alias("w700"), F.count_if(F.col("num") == 900).alias("w900"))


@query("o_i09_author_sheets", "SELECT page_id, u.css AS css FROM pages, unnest(regexp_extract_all(html, '<style>((?s:.*?))</style>', 1)) u(css)")
def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.author_sheets(P.parse_nodes(_pages(spark, sf_dir))).select("page_id", "css")


@query("o_i07_sheet_rules", "SELECT page_id, 1::BIGINT AS rules, 0::INT AS a, 0::INT AS b, 1::INT AS c, 'margin' AS name, '0' AS value FROM pages")
def sheet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of each page's sheets. Each distinct text is parsed once and joined back."""
    s = P.author_sheets(P.parse_nodes(_pages(spark, sf_dir)))
    distinct = s.select("css").distinct().withColumn("sheet_id", F.xxhash64("css"))
    rules = P.parse_rules(distinct).join(P.parse_rule_declarations(distinct), ["sheet_id", "rule"])
    return s.withColumn("sheet_id", F.xxhash64("css")).join(rules, "sheet_id").groupBy("page_id", "a", "b", "c", "name", "value").agg(F.count("*").alias("rules")).select("page_id", "rules", "a", "b", "c", "name", "value")


@query("o_i08_style_attribute_cases", "SELECT * FROM (VALUES (0::BIGINT, 'width', '2px', true, 'longhands'), (0, '--A', 'x y', false, 'custom'), (0, 'height', 'var(--A)', false, 'var'), (0, 'top', 'inherit', false, 'wide'), (0, 'left', 'red', false, 'ignored')) t(sheet_id, name, value, important, what)")
def style_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(0, "WIDTH: 2px ! important; --A: x y ; height:var(--A); 3; top: inherit; left: red")], "sheet_id long, css string")
    return P.parse_style_attributes(cases).select("sheet_id", "name", "value", "important", "what")


@query("o_i15_dump", "SELECT page_id, '| <!DOCTYPE html>' AS head, len(regexp_extract_all(html, '<li>'))::BIGINT AS li, len(regexp_extract_all(html, '<a href'))::BIGINT AS a FROM pages")
def dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of each page as text: its first line, and lines of li and a. Tests hold the whole against the kernel's own dump."""
    lines = navigate.dump(P.parse_nodes(_pages(spark, sf_dir))).select("page_id", F.split("dump", "\n").alias("x"))
    ends = lambda tag: F.size(F.filter("x", lambda line: line.endswith(f" <{tag}>"))).cast("long").alias(tag)
    return lines.select("page_id", F.get("x", F.lit(0)).alias("head"), ends("li"), ends("a"))


@query("o_c01_css_tokens", "SELECT * FROM (VALUES ('ident', 'p'), ('{', '{'), ('ident', 'margin'), (':', ':'), ('number', '0'), ('}', '}')) t(kind, value)")
def css_token_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the sheets of all pages, each once."""
    s = P.author_sheets(P.parse_nodes(_pages(spark, sf_dir))).select("css").distinct().withColumn("sheet_id", F.lit(0).cast("long"))
    return P.css_tokens(s).select("kind", "value").distinct()


# navigation


@query("o_n02_children", "SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS items FROM pages")
def list_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_pages(spark, sf_dir))
    return navigate.children(n, navigate.elements(n, "ul")).where("kind = 'element'").groupBy("page_id").agg(F.count("*").alias("items"))


@query("o_n03_descendants", "SELECT page_id, (len(regexp_extract_all(html, '<p>')) + 1)::BIGINT AS blocks FROM pages")
def article_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p and h1 elements below the article."""
    n = P.parse_nodes(_pages(spark, sf_dir), columns=["page_id", "node_id", "name", "kind", "path", "tree_root"])
    return navigate.descendants(n.where("name IN ('p', 'h1')"), navigate.elements(n, "article"), ["page_id", "node_id"]).groupBy("page_id").agg(F.count("*").alias("blocks"))


@query(
    "o_n04_relatives",
    """WITH u AS (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n FROM pages)
    SELECT page_id, n::BIGINT AS items, (n - 1)::BIGINT AS with_next, (n - 1)::BIGINT AS with_prev, n::BIGINT AS with_child FROM u""",
)
def list_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_pages(spark, sf_dir))
    r = navigate.relatives(n).join(navigate.elements(n, "li").select("page_id", "node_id"), ["page_id", "node_id"])
    return r.groupBy("page_id").agg(F.count("*").alias("items"), F.count("next_sibling").alias("with_next"), F.count("prev_sibling").alias("with_prev"), F.count("first_child").alias("with_child"))


@query("o_n07_clone", "SELECT page_id, (len(regexp_extract_all(html, '<li>')) + len(regexp_extract_all(html, '<a href')) + 1)::BIGINT AS elements FROM pages")
def cloned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_pages(spark, sf_dir))
    return navigate.clone_subtrees(n, navigate.elements(n, "ul")).where("kind = 'element'").groupBy("page_id").agg(F.count("*").alias("elements"))


@query("o_n06_reparent", "SELECT page_id, len(regexp_extract_all(html, '<li>'))::BIGINT AS moved FROM pages")
def moved_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items of the list moved to the footer."""
    n = P.parse_nodes(_pages(spark, sf_dir))
    moves = navigate.elements(n, "ul").select("page_id", F.col("node_id").alias("from_id")).join(navigate.elements(n, "footer").select("page_id", F.col("node_id").alias("to_id")), "page_id")
    after = navigate.reparent(n, moves).join(moves.select("page_id", F.col("to_id").alias("parent_id")), ["page_id", "parent_id"])
    items = navigate.elements(n, "li").select("page_id", "node_id")
    return after.join(items, ["page_id", "node_id"], "left_semi").groupBy("page_id").agg(F.count("*").alias("moved"))


# selectors

_LI = "len(regexp_extract_all(html, '<li>'))"
_SELECTED = {
    "o_q06_type": ("LI", _LI),
    "o_q07_class": (".ad", "len(regexp_extract_all(html, 'class=\"ad\"'))"),
    "o_q08_attr_prefix": ('a[href^="/t"]', "len(regexp_extract_all(html, '<a href=\"/t'))"),
    "o_q08_attr_word": ("[class~=ad]", "len(regexp_extract_all(html, 'class=\"ad\"'))"),
    "o_q08_attr_empty": ('a[href*=""]', "0"),
    "o_q09_attr_nocase": ("[charset='UTF-8']", "len(regexp_extract_all(html, '<meta charset=\"utf-8\">'))"),
    "o_q10_descendant": ("nav ul a", "len(regexp_extract_all(html, '<a href'))"),
    "o_q11_child": ("article > p", "len(regexp_extract_all(html, '<p>'))"),
    "o_q12_next": ("li + li", f"{_LI} - 1"),
    "o_q12_after": ("h1 ~ p", "len(regexp_extract_all(html, '<p>'))"),
    "o_q13_first": ("li:first-child, li:last-child", f"least({_LI}, 2)"),
    "o_q13_root": (":root", "1"),
    "o_q14_nth": ("li:nth-child(odd)", f"({_LI} + 1) // 2"),
    "o_q14_nth_last": ("li:nth-last-of-type(-n+2)", f"least({_LI}, 2)"),
    "o_q15_nth_of": ("li:nth-child(2 of :not(:first-child))", f"CASE WHEN {_LI} > 2 THEN 1 ELSE 0 END"),
    "o_q16_not": ("li:not(:first-child)", f"{_LI} - 1"),
    "o_q16_not_complex": ("p:not(article p)", "0"),
    "o_q17_is": (":is(h1, footer, nav)", "3"),
    "o_q17_where": (":where(ul, ol) li a", "len(regexp_extract_all(html, '<a href'))"),
    "o_q18_never": ("a:hover", "0"),
    "o_q18_not_never": ("a:not(:hover)", "len(regexp_extract_all(html, '<a href'))"),
    "o_q20_pseudo": ("p::before", "0"),
}


def _selection(selector: str, by_joins: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = _pages(spark, sf_dir)
        found = select(P.parse_nodes(p), selector) if by_joins else select_from_pages(p, selector)
        found = found.groupBy("page_id").agg(F.count("*").alias("n"))
        return p.select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n"))

    return run


for _name, (_selector, _count) in _SELECTED.items():
    query(_name, f"SELECT page_id, ({_count})::BIGINT AS n FROM pages")(_selection(_selector))
for _name in ("o_q10_descendant", "o_q11_child", "o_q12_next", "o_q12_after", "o_q15_nth_of", "o_q16_not_complex", "o_q17_where"):
    _selector, _count = _SELECTED[_name]
    query(f"{_name}_by_joins", f"SELECT page_id, ({_count})::BIGINT AS n FROM pages")(_selection(_selector, True))


@query("o_s05_kernel_selection", f"SELECT page_id, ({_LI} - 1)::BIGINT AS n FROM pages")
def kernel_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_by_kernel(_pages(spark, sf_dir), "nav li + li").groupBy("page_id").agg(F.count("*").alias("n"))


@query("o_q05_specificity_cases", _values(["case_id", "valid", "a", "b", "c"], [(i, s is not None, *(s or (-1, -1, -1))) for i, (_, s) in enumerate(X.SPECIFICITIES)], {"case_id": "BIGINT", "a": "INT", "b": "INT", "c": "INT"}))
def specificity_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specificities(spark.createDataFrame([(i, s) for i, (s, _) in enumerate(X.SPECIFICITIES)], "case_id long, selector string")).fillna(-1)


@query("o_c11_nth_cases", _values(["case_id", "valid", "a", "b"], [(i, a is not None, -99 if a is None else a, -99 if b is None else b) for i, (_, a, b) in enumerate(X.NTH)], {"case_id": "BIGINT", "a": "INT", "b": "INT"}))
def nth_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css_functions.nth(spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(X.NTH)], "case_id long, text string")).fillna(-99)


@query(
    "o_s03_rule_candidates",
    f"""SELECT page_id, 'li' AS key, ({_LI})::BIGINT AS n FROM pages UNION ALL SELECT page_id, 'ad', len(regexp_extract_all(html, 'class="ad"'))::BIGINT FROM pages""",
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = P.parse_rules(spark.createDataFrame([(0, "li{top:0} .ad{top:0} #none{top:0}")], "sheet_id long, css string"))
    found = cascade.rule_candidates(P.parse_nodes(_pages(spark, sf_dir)), F.broadcast(rules))  # as many rules as the sheet has
    return found.groupBy("page_id", "key").agg(F.count("*").alias("n"))


# values


@query("o_p01_property_cases", _values(["case_id", "longhand", "value"], [(i, n, v) for i, (_, _, d) in enumerate(X.PROPERTIES) for n, v in (d or {}).items()], {"case_id": "BIGINT"}))
def property_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(i, n, v) for i, (n, v, _) in enumerate(X.PROPERTIES)], "case_id long, property string, value string")
    return P.parse_properties(cases).select("case_id", "longhand", "value")


@query("o_k03_color_cases", _values(["case_id", "color"], [(i, c) for i, (_, c) in enumerate(X.COLORS)], {"case_id": "BIGINT"}))
def color_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return css_functions.colors(spark.createDataFrame([(i, v) for i, (v, _) in enumerate(X.COLORS)], "case_id long, value string")).select("case_id", "color")


_HEX = ("fff", "0f08", "102030", "a0b0c0d0", "12345", "xyz")


@query(
    "o_k01_hex",
    f"""WITH h AS (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in _HEX)}) t(hex)),
    d AS (SELECT hex, CASE WHEN length(hex) <= 4 THEN regexp_replace(hex, '(.)', '\\1\\1', 'g') ELSE hex END AS x FROM h WHERE regexp_full_match(hex, '[0-9a-f]{{3,4}}|[0-9a-f]{{6}}|[0-9a-f]{{8}}'))
    SELECT hex, ('0x' || x[1:2])::INT AS r, ('0x' || x[3:4])::INT AS g, ('0x' || x[5:6])::INT AS b FROM d""",
)
def hex_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = css_functions.hex_channels(F.col("hex"))
    return spark.createDataFrame([(x,) for x in _HEX], "hex string").withColumn("c", c).where("c IS NOT NULL").select("hex", "c.r", "c.g", "c.b")


@query(
    "o_k02_hsl",
    """WITH h AS (SELECT (range % 36) * 10.0 AS h, 50.0 AS s, (range % 11) * 10.0 AS l FROM range(396)),
    c AS (SELECT h, s, l, (1 - abs(2 * l / 100 - 1)) * s / 100 AS c FROM h)
    SELECT h::DOUBLE AS h, l::DOUBLE AS l,
      round(255 * (l / 100 - c / 2 + c * greatest(0, least(1, least(abs((h / 60 + 6) % 6 - 3) - 1, 1)))), 6)::DOUBLE AS r FROM c""",
)
def hsl_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.range(396).select(((F.col("id") % 36) * 10.0).alias("h"), ((F.col("id") % 11) * 10.0).alias("l"))
    return d.select("h", "l", F.round(css_functions.hsl_channels(F.col("h"), F.lit(50.0), F.col("l"))["r"], 6).alias("r"))


@query("o_v02_units", "SELECT * FROM (VALUES ('px', 1.0::DOUBLE), ('in', 96.0), ('cm', 96 / 2.54::DOUBLE), ('mm', 96 / 25.4::DOUBLE), ('q', 96 / 101.6::DOUBLE), ('pt', 96 / 72::DOUBLE), ('pc', 16.0)) t(unit, px)")
def unit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.units(spark).where("px IS NOT NULL")


@query("o_p07_inherited", "SELECT unnest(['font-family', 'font-size', 'font-weight', 'line-height', 'visibility']) AS property")
def inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade.properties(spark).where("inherited").select("property")


@query("o_v01_numbers", "SELECT * FROM (VALUES (0::BIGINT, '33.3333'), (1, '0'), (2, '1234568'), (3, '0.1'), (4, '-2.5'), (5, '100000'), (6, '0.000123456')) t(case_id, text)")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(list(enumerate([100 / 3, 0.0, 1234567.8, 0.1, -2.5, 100000.0, 0.000123456])), "case_id long, v double")
    return d.select("case_id", css_functions.format_number(F.col("v")).alias("text"))


@query("o_x03_variable_cases", _values(["case_id", "value"], [(i, c[3]) for i, c in enumerate(X.VARIABLES)], {"case_id": "BIGINT"}))
def variable_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(i: int, parent: str, style: str, name: str):
        of = lambda s: [(n, v) for n, v, _ in raw_declarations(preprocess(s))]
        yield i, compute_custom(of(style), compute_custom(of(parent), {})).get(name, "")

    cases = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(X.VARIABLES)], "case_id long, parent string, style string, name string")
    return flat_map(cases, kernel, "case_id long, value string")


@query("o_m01_media_cases", _values(["case_id", "media", "matches"], [(i, m, t) for i, (_, m, t) in enumerate(X.MEDIA)], {"case_id": "BIGINT"}))
def media_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_by_kernel(spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(X.MEDIA)], "case_id long, query string"), DESKTOP)


@query("o_m04_media_native", _values(["case_id", "matches"], [(i, t) for i, (_, _, t) in enumerate(X.MEDIA)], {"case_id": "BIGINT"}))
def media_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = DESKTOP
    env = spark.createDataFrame([(0, e.media_type, e.width, e.height, e.device_width, e.device_height, e.resolution, e.color, e.font_size, e.features)], media.ENVIRONMENT)
    return media.match_media(env, [q for q, _, _ in X.MEDIA]).select("case_id", "matches")


@query("o_m08_supports_cases", _values(["case_id", "supported"], [(i, t) for i, (_, t) in enumerate(X.SUPPORTS)], {"case_id": "BIGINT"}))
def supports_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.supports_by_kernel(spark.createDataFrame([(i, c) for i, (c, _) in enumerate(X.SUPPORTS)], "case_id long, condition string"))


# cascade

_DECLARED = [(n, p, f"v{n * 7 + k}", (n + k) % 3 > 0, (n * k) % 4 == 0, k % 5 == 0, (n * 3 + k) % 2, (n + k * 2) % 3, k % 2, k, 0) for n in range(6) for p in ("width", "top") for k in range(5)]
_DECLARED_SQL = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in _DECLARED)


@query(
    "o_s08_winners",
    f"""WITH d AS (SELECT * FROM (VALUES {_DECLARED_SQL}) t(node_id, property, value, author, important, inline, a, b, c, rule, decl)),
    r AS (SELECT node_id, property, value, row_number() OVER (PARTITION BY node_id, property ORDER BY
      CASE WHEN author AND important THEN 2 WHEN important THEN 3 WHEN author THEN 1 ELSE 0 END DESC, (NOT important)::INT DESC, inline DESC, a DESC, b DESC, c DESC, rule DESC, decl DESC) AS n FROM d)
    SELECT node_id::INT AS node_id, property, value FROM r WHERE n = 1""",
)
def winner_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame(_DECLARED, "node_id int, property string, value string, author boolean, important boolean, inline boolean, a int, b int, c int, rule int, decl int")
    order = cascade.priority(F.col("author"), F.col("important"), F.lit(False), F.col("inline"), F.struct("a", "b", "c"), F.col("rule"), F.col("decl"))
    return cascade.winners(d.withColumn("priority", order), ["node_id", "property"])


@query("o_s06_p_margins", "SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS p, 0.0::DOUBLE AS most FROM pages")
def p_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author's p{margin:0} beats the default 1em."""
    s = P.compute_styles(_pages(spark, sf_dir), properties=["margin-top"], tags=["p"])
    return s.groupBy("page_id").agg(F.count("*").alias("p"), F.max("px").alias("most"))


@query("o_s12_h1_size", "SELECT page_id, 32.0::DOUBLE AS px FROM pages")
def h1_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compute_styles(_pages(spark, sf_dir), properties=["font-size"], tags=["h1"]).select("page_id", "px")


@query("o_s14_h1_margin", "SELECT page_id, 21.44::DOUBLE AS px FROM pages")
def h1_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compute_styles(_pages(spark, sf_dir), properties=["margin-top"], tags=["h1"]).select("page_id", F.round("px", 4).alias("px"))


@query("o_i11_li_display", f"SELECT page_id, 'list-item' AS display, ({_LI})::BIGINT AS n FROM pages")
def li_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compute_styles(_pages(spark, sf_dir), properties=["display"], tags=["li"]).groupBy("page_id", F.col("text").alias("display")).agg(F.count("*").alias("n"))


@query("o_i16_resolved", "SELECT page_id, p.property, p.text FROM pages, (VALUES ('display', 'block'), ('margin-left', '8px'), ('font-family', 'serif'), ('line-height', 'normal'), ('width', 'auto'), ('opacity', '1')) p(property, text)")
def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["display", "margin-left", "font-family", "line-height", "width", "opacity"]
    return P.compute_styles(_pages(spark, sf_dir), properties=names, tags=["body"]).select("page_id", "property", "text")


@query("o_s23_style_count", _B_MODEL + """, b AS (SELECT page_id, count(*) AS b FROM e GROUP BY page_id)
SELECT page_id, (len(regexp_extract_all(html, '<[a-z][a-z0-9]*[ >]')) - len(regexp_extract_all(html, '<b>')) + coalesce(b, 0))::BIGINT AS styled FROM pages LEFT JOIN b USING (page_id)""")
def style_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.compute_styles(_pages(spark, sf_dir), properties=["display"]).groupBy("page_id").agg(F.count("*").alias("styled"))


_TREE = [(0, None, "400"), (1, 0, "bolder"), (2, 1, "bolder"), (3, 2, "lighter"), (4, 1, None), (5, 4, "lighter"), (6, 0, "lighter"), (7, 6, "bolder"), (8, 7, "bold"), (9, 2, "bolder")]


@query(
    "o_s13_weight_inherit",
    f"""WITH RECURSIVE t AS ({_values(["id", "parent", "word"], _TREE)}),
    w AS (SELECT id, 400.0::DOUBLE AS weight FROM t WHERE parent IS NULL
      UNION ALL SELECT t.id, CASE WHEN word IS NULL THEN weight WHEN word = 'bold' THEN 700
        WHEN word = 'bolder' THEN CASE WHEN weight < 350 THEN 400 WHEN weight < 550 THEN 700 ELSE greatest(weight, 900) END
        ELSE CASE WHEN weight < 100 THEN weight WHEN weight < 550 THEN 100 WHEN weight < 750 THEN 400 ELSE 700 END END::DOUBLE FROM t JOIN w ON t.parent = w.id)
    SELECT id::INT AS id, weight FROM w""",
)
def weight_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down a tree level by level: as many joins as the tree is deep."""
    t = spark.createDataFrame(_TREE, "id int, parent int, word string")
    level = t.where("parent IS NULL").select("id", F.lit(400.0).alias("weight"))
    levels = [level]
    for _ in range(4):
        up = level.select(F.col("id").alias("parent"), F.col("weight").alias("_w"))
        level = t.join(up, "parent").select("id", cascade.relative_weight(F.col("_w"), F.col("word")).alias("weight"))
        levels.append(level)
    return reduce(DataFrame.union, levels)


@query(
    "o_s11_inherit_nearest",
    """WITH u AS (SELECT page_id, len(regexp_extract_all(html, '<a href')) AS links, len(regexp_extract_all(html, '<p>')) AS ps FROM pages)
    SELECT page_id, 'hidden' AS value, links::BIGINT AS n FROM u WHERE links > 0 UNION ALL SELECT page_id, 'visible', ps::BIGINT FROM u""",
)
def inherit_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """visibility of links and paragraphs when nav declares hidden."""
    n = P.parse_nodes(_pages(spark, sf_dir), columns=["page_id", "node_id", "path", "name", "kind", "tree_root"])
    declared = navigate.elements(n, "nav").select("page_id", "node_id", F.lit("hidden").alias("value"))
    got = cascade.inherit_nearest(n.where("name IN ('a', 'p')"), declared, "visible")
    return got.groupBy("page_id", "value").agg(F.count("*").alias("n"))


@query("o_s10_keywords", "SELECT * FROM (VALUES (0, 'visibility', 'hidden'), (1, 'visibility', 'collapse'), (2, 'visibility', 'visible'), (0, 'width', 'auto'), (1, 'width', '7px'), (2, 'width', 'auto')) t(node_id, property, value)")
def keyword_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = spark.createDataFrame([(0, "visibility", "unset"), (2, "visibility", "initial"), (1, "visibility", "collapse"), (0, "width", "revert"), (1, "width", "inherit")], "node_id int, property string, value string")
    parents = spark.createDataFrame([(i, p, v) for i in range(3) for p, v in (("visibility", "hidden"), ("width", "7px"))], "node_id int, property string, parent_value string")
    return cascade.resolve_keywords(won, parents)


@query("o_s17_borders", "SELECT w::DOUBLE AS w, s, r::DOUBLE AS r, CASE WHEN s IN ('none', 'hidden') OR w <= 0 THEN 0 ELSE greatest(floor(w * r), 1) / r END::DOUBLE AS used FROM (SELECT range / 4.0 AS w FROM range(20)), (SELECT unnest(['none', 'solid', 'hidden']) AS s), (SELECT unnest([1.0, 2.0, 1.5]) AS r)")
def borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.range(20).select((F.col("id") / 4.0).alias("w"), F.explode(F.array(F.lit("none"), F.lit("solid"), F.lit("hidden"))).alias("s"))
    d = d.select("w", "s", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(1.5))).alias("r"))
    return d.select("w", "s", "r", cascade.border_width(F.col("w"), F.col("s"), F.col("r")).alias("used"))


@query("o_s18_overflow", "SELECT x, y, CASE WHEN (x IN ('visible', 'clip')) = (y IN ('visible', 'clip')) THEN x WHEN x = 'visible' THEN 'auto' WHEN x = 'clip' THEN 'hidden' ELSE x END AS used FROM (SELECT unnest(['visible', 'hidden', 'clip', 'scroll', 'auto']) AS x), (SELECT unnest(['visible', 'hidden', 'clip', 'scroll', 'auto']) AS y)")
def overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("visible", "hidden", "clip", "scroll", "auto")))
    d = spark.range(1).select(F.explode(words).alias("x")).select("x", F.explode(words).alias("y"))
    return d.select("x", "y", cascade.overflow_pair(F.col("x"), F.col("y"))[0].alias("used"))


@query("o_s19_blockify", "SELECT * FROM (VALUES ('inline', 'block'), ('inline-flex', 'flex'), ('inline-table', 'table'), ('table-row', 'block'), ('list-item', 'list-item'), ('math', 'block math'), ('none', 'none'), ('ruby-text', 'block')) t(display, used)")
def blockified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(x,) for x in ("inline", "inline-flex", "inline-table", "table-row", "list-item", "math", "none", "ruby-text")], "display string")
    return d.select("display", cascade.blockify(F.col("display")).alias("used"))


@query("o_s14_lengths", "SELECT * FROM (VALUES ('px', 2.0::DOUBLE), ('em', 40.0), ('rem', 32.0), ('in', 192.0), ('vw', 20.48), ('vmin', 15.36), ('ch', 20.0), ('lh', 48.0), ('pt', 2.666667)) t(unit, px)")
def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.createDataFrame([(u,) for u in ("px", "em", "rem", "in", "vw", "vmin", "ch", "lh", "pt")], "unit string")
    return d.select("unit", F.round(cascade.length_px(F.lit(2.0), F.col("unit"), F.lit(20.0), F.lit(16.0), F.lit(1024.0), F.lit(768.0)), 6).alias("px"))


def _slotted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, X.SLOTTED)], "page_id long, html string")


@query("o_s20_shadow_style_cases", "SELECT * FROM (VALUES ('b', '0.5'), ('div', '1'), ('i', '1'), ('u', '1')) t(name, opacity)")
def shadow_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a shadow tree hold in it alone; the child without a slot has no style."""
    o = Options(declarative_shadow_roots=True)
    n = P.parse_nodes(_slotted(spark), o).select("page_id", "node_id", "name")
    s = P.compute_styles(_slotted(spark), properties=["opacity"], options=o).join(n, ["page_id", "node_id"])
    return s.where("name IN ('b', 'div', 'i', 'u', 's')").select("name", F.col("text").alias("opacity"))


@query("o_s21_slot_cases", "SELECT * FROM (VALUES ('x', 'i'), ('', '#text'), ('', 'u')) t(slot, node)")
def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_slotted(spark), Options(declarative_shadow_roots=True))
    given = cascade.assign_slots(n)
    names = n.select("page_id", F.col("node_id").alias("slot_id"), F.coalesce(F.element_at("attrs", "name"), F.lit("")).alias("slot"))
    return given.join(names, ["page_id", "slot_id"]).join(n.select("page_id", "node_id", F.coalesce("name", F.lit("#text")).alias("node")), ["page_id", "node_id"]).select("slot", "node")


@query("o_s22_flat_tree_cases", "SELECT * FROM (VALUES ('div', 'style'), ('div', 'b'), ('div', 'slot'), ('b', 'slot'), ('slot', 'i'), ('slot', 'u'), ('slot', '#text')) t(parent, child)")
def flat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_slotted(spark), Options(declarative_shadow_roots=True))
    name = F.when(F.col("kind") == "text", "#text").otherwise(F.col("name"))
    up, down = n.select("page_id", F.col("node_id").alias("parent_id"), name.alias("parent")), n.select("page_id", F.col("node_id").alias("child_id"), name.alias("child"))
    e = cascade.flat_edges(n).join(up, ["page_id", "parent_id"]).join(down, ["page_id", "child_id"])
    return e.where("parent IN ('div', 'b', 'slot')").select("parent", "child")


# layout and fonts


@query("o_l05_article_boxes", "SELECT page_id, 8.0::DOUBLE AS x, 1008.0::DOUBLE AS w FROM pages")
def article_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a window of 1024 px the body's margins leave 1008 to the article."""
    return P.layout_boxes(_pages(spark, sf_dir)).where("tag = 'article' AND kind = 'block'").select("page_id", "x", "w")


@query("o_l01_box_counts", "SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS p, 0::BIGINT AS hidden FROM pages")
def box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each p makes a block; head, style, script and title make no box."""
    b = P.layout_boxes(_pages(spark, sf_dir), columns=["page_id", "tag", "kind"])
    return b.groupBy("page_id").agg(F.count_if((F.col("tag") == "p") & (F.col("kind") == "block")).alias("p"), F.count_if(F.col("tag").isin("head", "style", "script", "title")).alias("hidden"))


@query("o_i12_layout_cases", _values(["case_id", "n", "x", "y", "w", "h"], [(i, k, *r) for i, (_, _, rs) in enumerate(X.LAYOUTS) for k, r in enumerate(rs)], {"case_id": "BIGINT", "n": "BIGINT"}))
def layout_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(i, h) for i, (h, _, _) in enumerate(X.LAYOUTS)], "page_id long, html string")
    tags = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(X.LAYOUTS)], "page_id long, tag string")
    b = P.layout_boxes(cases, Environment(width=800.0, height=600.0)).join(tags, ["page_id", "tag"])
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("box_id")) - 1
    return b.select(F.col("page_id").alias("case_id"), n.cast("long").alias("n"), "x", "y", "w", "h")


def _face() -> Font:
    """Every letter and the space half an em, one kerned pair."""
    return Font.synthetic("Times", {c: 500 for c in "abcdefghijklmnopqrstuvwxyz "}, pairs={("a", "b"): -100})


@query("o_l10_line_cases", "SELECT * FROM (VALUES (0::BIGINT, 0.0::DOUBLE, 24.0::DOUBLE, 54.0::DOUBLE), (1, 40.0, 24.0, 18.0)) t(case_id, x, w, h)")
def line_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three words of three letters in 30 px stand on three lines; an inline element begins where the text before it ends."""
    style = "<!doctype html><body style='margin:0'>"
    cases = spark.createDataFrame([(0, style + "<p style='margin:0;width:30px'><i>aaa ccc ddd</i>"), (1, style + "<p style='margin:0'>cccc <i>ddd</i>")], "page_id long, html string")
    b = P.layout_boxes(cases, fonts=[_face()]).where("tag = 'i'")
    return b.select(F.col("page_id").alias("case_id"), F.round("x", 4).alias("x"), F.round("w", 4).alias("w"), F.round("h", 4).alias("h"))


@query("o_l03_layout_units", "SELECT range::BIGINT AS id, trunc((range - 50) * 0.37 * 128) / 64 / 2 AS cut FROM range(100)")
def layout_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(100).select("id", css_functions.layout_unit((F.col("id") - 50) * F.lit(0.37), F.lit(2.0)).alias("cut"))


_FACE_VALUES = ", ".join(f"({i}, '{f}', {w}, {str(t).upper()})" for i, (f, w, t) in enumerate(X.FACES))
_WANTED_VALUES = ", ".join(f"({i}, '{f}', {w}, {str(t).upper()})" for i, (f, w, t, _) in enumerate(X.NEAREST))


@query(
    "o_f09_nearest_face",
    f"""WITH f AS (SELECT * FROM (VALUES {_FACE_VALUES}) t(id, family, weight, italic)), q AS (SELECT * FROM (VALUES {_WANTED_VALUES}) t(id, family, weight, italic))
    SELECT q.id::BIGINT AS request_id, arg_min(f.id, (f.italic <> q.italic)::INT * 100000 + abs(f.weight - q.weight) * 10 + f.id +
      CASE WHEN (q.weight <= 500 AND f.weight > q.weight) OR (q.weight > 500 AND f.weight < q.weight) THEN 10000 ELSE 0 END)::INT AS face_id
    FROM q JOIN f ON lower(f.family) = CASE WHEN lower(q.family) = 'serif' THEN 'times' ELSE lower(q.family) END GROUP BY q.id""",
)
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = spark.createDataFrame([(i, *f) for i, f in enumerate(X.FACES)], "face_id int, family string, weight int, italic boolean")
    wanted = spark.createDataFrame([(i, *n[:3]) for i, n in enumerate(X.NEAREST)], "request_id long, family string, weight int, italic boolean")
    return fonts.nearest_face(wanted, faces)


@query(
    "o_f05_text_widths",
    """SELECT r_regionkey::INT AS text_id, (length(r_name) * 500 - 100 * (length(r_name) - length(replace(r_name, 'AS', 'A'))))::BIGINT AS units FROM region""",
)
def text_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names set in a face where every character is 500 units wide and AS is kerned by -100."""
    texts = _table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("text_id"), F.lit(0).alias("face_id"), F.col("r_name").alias("text"))
    cmap = spark.range(32, 127).select(F.lit(0).alias("face_id"), F.col("id").cast("int").alias("code"), (F.col("id") - 31).cast("int").alias("glyph"))
    advances = cmap.select("face_id", "glyph", F.lit(500).alias("advance"))
    kerning = spark.createDataFrame([(0, ord("A") - 31, ord("S") - 31, -100)], "face_id int, left int, right int, value int")
    return fonts.text_widths(fonts.glyphs(texts, cmap), advances, kerning).select("text_id", "units")


@query("o_f08_line_metrics", "SELECT f AS family, s::DOUBLE AS size, (round(s * 0.75) + CASE WHEN f = 'Times' THEN floor((round(s * 0.75) + round(s * 0.25)) * 0.15 + 0.5) ELSE 0 END)::DOUBLE AS ascent, round(s * 0.25)::DOUBLE AS descent FROM (SELECT unnest(['Times', 'Other']) AS f), (SELECT range + 8.0 AS s FROM range(40))")
def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.range(40).select(F.explode(F.array(F.lit("Times"), F.lit("Other"))).alias("family"), (F.col("id") + 8.0).alias("size"))
    m = fonts.line_metrics(F.col("family"), F.lit(1536), F.lit(-512), F.lit(0), F.lit(2048), F.col("size"))
    return d.select("family", "size", m["ascent"].alias("ascent"), m["descent"].alias("descent"))


def _font_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{i}.ttf", bytearray(X.font_file(**c[0]))) for i, c in enumerate(X.FONTS)], "path string, content binary")


@query("o_i13_font_files", _values(["path", "family", "weight", "units_per_em", "glyphs", "ascender", "line_gap"], [(f"{i}.ttf", *c[1:5], 800, 50) for i, c in enumerate(X.FONTS)], {"weight": "INT", "units_per_em": "INT", "glyphs": "INT", "ascender": "INT", "line_gap": "INT"}))
def font_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of font files built table by table; tests read such files from a folder."""
    return P.font_faces(_font_files(spark)).select("path", "family", "weight", "units_per_em", "glyphs", F.col("ascender").cast("int").alias("ascender"), F.col("line_gap").cast("int").alias("line_gap"))


@query("o_i14_font_kerning", _values(["path", "advances"], [(f"{i}.ttf", c[5]) for i, c in enumerate(X.FONTS)], {}))
def font_kerning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advances of "ab" by the files' own metrics, kern and GPOS tables."""
    return flat_map(_font_files(spark), lambda path, content: [(path, " ".join(map(str, Font.parse(bytes(content)).kerned_advances("ab"))))], "path string, advances string")


# more fixed cases of the kernels


def _cases(spark: SparkSession, rows: list[tuple], kernel: Callable[..., object], result: str, kind: str = "string") -> DataFrame:
    """(case_id, result) of a kernel over literal cases."""
    columns = ", ".join(f"c{i} string" for i in range(len(rows[0])))
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case_id long, {columns}")
    return flat_map(cases, lambda i, *args: [(i, kernel(*args))], f"case_id long, {result} {kind}")


@query("o_t14_doctype_cases", _values(["case_id", "name", "public_id", "system_id", "quirks"], [(i, *c[1:]) for i, c in enumerate(X.DOCTYPES)], {"case_id": "BIGINT"}))
def doctypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(i: int, html: str):
        t = parse(html)
        d = next(k for k in t.doc.kids if k.kind == "doctype")
        yield i, d.name, *d.extra, t.quirks

    return flat_map(spark.createDataFrame([(i, c[0]) for i, c in enumerate(X.DOCTYPES)], "case_id long, html string"), kernel, "case_id long, name string, public_id string, system_id string, quirks string")


@query("o_t11_remark_cases", _values(["case_id", "remarks"], list(enumerate(c[1] for c in X.REMARKS)), {"case_id": "BIGINT"}))
def remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(html: str) -> str:
        return "|".join(n.data if n.kind == "comment" else f"?{n.name} {n.data}" for n in tree_nodes(parse(html).doc) if n.kind in ("comment", "pi"))

    return _cases(spark, [(c[0],) for c in X.REMARKS], kernel, "remarks")


@query("o_c10_serialised_cases", _values(["case_id", "css"], list(enumerate(c[1] for c in X.SERIALISED)), {"case_id": "BIGINT"}))
def serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, [(c[0],) for c in X.SERIALISED], lambda css: to_css(parse_values(preprocess(css))), "css")


@query("o_c06_rule_cases", _values(["case_id", "rules"], list(enumerate(f"{c[1]}/{c[2]}" for c in X.RULES)), {"case_id": "BIGINT"}))
def rule_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(css: str) -> str:
        rules = parse_rules(preprocess(css))
        return " ".join(r["kind"] for r in rules) + "/" + " ".join(r["name"] for r in rules if r["name"])

    return _cases(spark, [(c[0],) for c in X.RULES], kernel, "rules")


@query("o_c12_declaration_cases", _values(["case_id", "declarations"], list(enumerate(c[1] for c in X.BLOCKS)), {"case_id": "BIGINT"}))
def block_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, [(c[0],) for c in X.BLOCKS], lambda css: "|".join(f"{n}={v}{'!' if i else ''}" for n, v, i in raw_declarations(preprocess(css))), "declarations")


@query("o_x02_substitution_cases", _values(["case_id", "value"], [(i, c[2] or "invalid") for i, c in enumerate(X.SUBSTITUTIONS)], {"case_id": "BIGINT"}))
def substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, [c[:2] for c in X.SUBSTITUTIONS], lambda value, known: substitute(value, {n: v for n, v, _ in raw_declarations(known)}) or "invalid", "value")


@query("o_c07_one_rule_cases", _values(["case_id", "outcome"], list(enumerate(c[1] for c in X.ONE_RULE)), {"case_id": "BIGINT"}))
def one_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(css: str) -> str:
        rule, why = parse_rule(preprocess(css))
        return why if rule is None else rule["kind"]

    return _cases(spark, [(c[0],) for c in X.ONE_RULE], kernel, "outcome")


@query("o_c07_one_declaration_cases", _values(["case_id", "outcome"], list(enumerate(c[1] for c in X.ONE_DECLARATION)), {"case_id": "BIGINT"}))
def one_declaration(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(css: str) -> str:
        got, why = parse_one_declaration(preprocess(css))
        return why if got is None else f"{got[0]}={to_css(got[1])}{'!' if got[2] else ''}"

    return _cases(spark, [(c[0],) for c in X.ONE_DECLARATION], kernel, "outcome")


@query("o_c08_contents_cases", _values(["case_id", "contents"], list(enumerate(c[1] for c in X.CONTENTS)), {"case_id": "BIGINT"}))
def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(css: str) -> str:
        said = {"declaration": lambda x: f"{x['name']}={to_css(x['value'])}", "at": lambda x: f"@{x['name']}", "style": lambda x: "{}"}
        return "|".join(said[x["kind"]](x) for x in block_contents(parse_values(preprocess(css))))

    return _cases(spark, [(c[0],) for c in X.CONTENTS], kernel, "contents")


@query("o_s01_style_cases", _values(["case_id", "value"], list(enumerate(c[3] for c in X.STYLES)), {"case_id": "BIGINT"}))
def style_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets with conditions, the cascade, failing var(), font sizes, line heights and calc(): a property of the first element of a name."""
    pages = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(X.STYLES)], "page_id long, html string, tag string, wanted string")
    styles = P.compute_styles(pages, DESKTOP, sorted({c[2] for c in X.STYLES})).select("page_id", "node_id", "property", "text")
    named = P.parse_nodes(pages, columns=["page_id", "node_id", "name"]).join(pages.select("page_id", F.col("tag").alias("name"), F.col("wanted").alias("property")), ["page_id", "name"])
    return styles.join(named, ["page_id", "node_id", "property"]).groupBy(F.col("page_id").alias("case_id")).agg(F.min_by("text", "node_id").alias("value"))


_PLAIN_TREES = [(i, *c) for i, c in enumerate(X.TREES) if "content/" not in c[1]]


@query("o_i15_dump_cases", _values(["case_id", "dump"], [(i, d) for i, _, d in _PLAIN_TREES], {"case_id": "BIGINT"}))
def dump_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """navigate.dump() of the trees of o_d03, in their short form: a space for each level, lines joined."""
    pages = spark.createDataFrame([c[:2] for c in _PLAIN_TREES], "page_id long, html string")
    lines = F.split(F.substr("dump", F.lit(3)), r"\n\| ")
    short = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"\G  ", " ")), "/")
    return navigate.dump(P.parse_nodes(pages)).select(F.col("page_id").alias("case_id"), short.alias("dump"))


@query("o_q19_host_cases", _values(["case_id", "means_host"], list(enumerate(c[1] for c in X.HOSTS)), {"case_id": "BIGINT"}))
def host_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(selector: str) -> bool:
        div = next(n for n in tree_nodes(parse("<div class=a>").doc) if n.name == "div")
        return any(matches_host(c, div, Index()) for c in parse_selectors(selector))

    return _cases(spark, [(c[0],) for c in X.HOSTS], kernel, "means_host", "boolean")


@query("o_f06_kerning_cases", "SELECT * FROM (VALUES (0::BIGINT, '400 500'), (1, '500 500'), (2, '500')) t(case_id, advances)")
def kerned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a before b is kerned, b before a and a alone are not."""
    return _cases(spark, [("ab",), ("ba",), ("a",)], lambda text: " ".join(map(str, _face().kerned_advances(text))), "advances")


@query("o_n01_lookup", "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.parse_nodes(_pages(spark, sf_dir), columns=["page_id", "is_root", "attrs"])
    return n.where("is_root").select("page_id", F.element_at("attrs", "lang").alias("lang"))


# relational building blocks over the other tables


@query(
    "r_join_group",
    """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""",
)
def join_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("r_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("r_top_orders", "SELECT o_custkey, o_orderkey, r::BIGINT AS r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's three largest orders."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("r")).where("r <= 3")


@query("r_set_operations", "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 0 EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 3")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation")
    a = _table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).intersect(_table(spark, sf_dir, "customer").select("c_nationkey"))
    return a.union(n.where("n_regionkey = 0").select("n_nationkey")).distinct().subtract(n.where("n_regionkey = 3").select("n_nationkey"))


@query("r_semi_anti", "SELECT count(*) FILTER (o_custkey IS NOT NULL) AS with_orders, count(*) FILTER (o_custkey IS NULL) AS without FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    a = c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("with_orders"))
    return a.join(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("without")))  # one row each


@query("r_event_windows", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)

