"""The library's front: a corpus of pages, and its tables for SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..kernels.css_media import Environment
from ..kernels.css_syntax import preprocess, tokens
from ..kernels.css_selectors import parse_selectors
from ..kernels.font import Font
from ..kernels.html_lexer import Lexer
from ..kernels.html_tree import Options, parse
from ..operators import navigate
from ..operators.select import select_from_pages
from ..sources import pages as sources


class Corpus:
    """Pages (page_id, html) and what can be asked of them.

    corpus.nodes(), .select("article > h1"), .styles(), .layout(), .tokens(), .text("h1"); views() makes them tables for SQL.
    """

    def __init__(self, pages: DataFrame, options: Options | None = None, environment: Environment | None = None, fonts: list[Font] | None = None):
        self.pages, self.options, self.environment, self.fonts = pages, options or Options(), environment or Environment(), fonts

    @cached_property
    def _nodes(self) -> DataFrame:
        return sources.parse_nodes(self.pages, self.options)

    def nodes(self, columns: list[str] | None = None) -> DataFrame:
        return self._nodes if columns is None else sources.parse_nodes(self.pages, self.options, columns)

    def tokens(self) -> DataFrame:
        return sources.tokenize(self.pages)

    def select(self, selector: str, columns: list[str] | None = None) -> DataFrame:
        """Rows of nodes that a selector list fits; pages are parsed once."""
        return select_from_pages(self._with_tag(selector), selector, self.options, columns)

    def _with_tag(self, selector: str) -> DataFrame:
        """Pages that can hold the selector at all: a tag that no rule implies must stand in the raw text.

        Only for one selector with a type whose element is never implied or renamed; anything else reads every page."""
        parsed = parse_selectors(selector)
        implied = {"html", "head", "body", "tbody", "colgroup", "tr", "p", "img", "br", "selectedcontent"}
        if parsed and len(parsed) == 1:
            names = [s[1].lower() for s in parsed[0][0][0] if s[0] == "type"]
            if names and names[0] not in implied and names[0].isascii():
                return self.pages.where(F.lower("html").contains(f"<{names[0]}"))
        return self.pages

    def text(self, selector: str) -> DataFrame:
        return navigate.text_content(self._nodes, self.select(selector))

    def sheets(self) -> DataFrame:
        return sources.author_sheets(self._nodes)

    def styles(self, properties: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
        return sources.compute_styles(self.pages, self.environment, properties, self.options, tags)

    def wide_styles(self, properties: list[str], tags: list[str] | None = None) -> DataFrame:
        """One row for each element, one column for each property; the list is given, so nothing runs to find it."""
        return self.styles(properties, tags).groupBy("page_id", "node_id").pivot("property", properties).agg(F.first("text"))

    def layout(self) -> DataFrame:
        return sources.layout_boxes(self.pages, self.environment, self.fonts, self.options)

    def views(self, prefix: str = "") -> None:
        """Temporary views pages, tokens, nodes, attributes, computed and boxes, and the table functions of register_functions()."""
        self.pages.createOrReplaceTempView(f"{prefix}pages")
        self.tokens().createOrReplaceTempView(f"{prefix}tokens")
        self._nodes.createOrReplaceTempView(f"{prefix}nodes")
        attrs = self._nodes.where("kind = 'element'").select("page_id", "node_id", F.posexplode("attr_list").alias("ord", "a")).select("page_id", "node_id", "ord", "a.ns", "a.name", "a.value")
        attrs.createOrReplaceTempView(f"{prefix}attributes")
        self.styles().createOrReplaceTempView(f"{prefix}computed")
        self.layout().createOrReplaceTempView(f"{prefix}boxes")
        register_functions(self.pages.sparkSession)

    def sql(self, query: str) -> DataFrame:
        self.views()
        return self.pages.sparkSession.sql(query)


def _without(schema: str, name: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields if f.name != name)


def register_functions(spark: SparkSession) -> None:
    """SQL table functions tokenize_html(html), html_nodes(html) and css_tokens(css), to be used with LATERAL."""
    from pyspark.sql.functions import udtf

    from ..session import ship

    ship(spark)

    class TokenizeHtml:
        def eval(self, html: str):
            for pos, t in enumerate(Lexer(html or "")):
                text = t[0] in ("text", "comment")
                yield pos, t[0], None if text or t[0] == "eof" else t[1], t[1] if text else t[2] if t[0] == "pi" else None

    class HtmlNodes:
        def eval(self, html: str):
            if html is not None:
                built = parse(html)
                for r in sources.node_rows(0, built.doc, built.quirks):
                    yield r[1:]

    class CssTokens:
        def eval(self, css: str):
            for i, t in enumerate(tokens(preprocess(css or ""))):
                yield i, t.kind, t.value, t.num, t.integer, t.unit, t.start, t.end

    spark.udtf.register("tokenize_html", udtf(TokenizeHtml, returnType="pos int, kind string, name string, data string"))
    spark.udtf.register("html_nodes", udtf(HtmlNodes, returnType=_without(schemas.NODES, "page_id")))
    spark.udtf.register("css_tokens", udtf(CssTokens, returnType=_without(schemas.CSS_TOKENS, "sheet_id")))
