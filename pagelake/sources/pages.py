"""Pages into tables: tokens, nodes, sheets, computed styles and boxes. Each is one narrow pass of a kernel."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..kernels.css_media import Environment
from ..kernels.css_syntax import preprocess, tokens
from ..kernels.css_values import PROPERTIES, format_value, parse_property
from ..kernels.css_selectors import specificity
from ..kernels.font import Faces, Font, FontFile, faces_of
from ..kernels.html_lexer import Lexer
from ..kernels.html_tree import Node, Options, parse, parse_fragment
from ..kernels.layout import Layout
from ..kernels.style import Styles, parse_declarations, parse_sheet
from ..session import flat_map


def tokenize(pages: DataFrame, state: str = "data", last_start: str = "", columns: list[str] | None = None) -> DataFrame:
    """HTML tokens of page_id, html; `state` is data, rcdata, rawtext, script or plaintext. A null page has no tokens."""

    def kernel(page_id: int, html: str | None) -> Iterator[tuple]:
        if html is None:
            return
        for pos, t in enumerate(Lexer(html, state, last_start)):
            k = t[0]
            name = data = None
            attrs: list = []
            closing = public = system = quirks = None
            if k in ("start", "end"):
                name, closing = t[1], t[3]
                attrs = [("", n, v) for n, v in t[2]]
            elif k == "pi":
                name, data = t[1], t[2]
            elif k == "doctype":
                name, public, system, quirks = t[1:]
            elif k != "eof":
                data = t[1]
            yield page_id, pos, k, name, data, closing, attrs, public, system, quirks

    return flat_map(pages.select("page_id", "html"), kernel, schemas.TOKENS, columns)


def node_rows(page_id: int, doc: Node, quirks: str = "no-quirks") -> Iterator[tuple]:
    """Rows of NODES. Numbers follow document order; a shadow root and a template's contents are trees of their own, numbered behind their host."""
    rows: list[list] = []
    number: dict[int, int] = {}

    def places(n: Node) -> dict[int, tuple[int, int, int, int]]:
        elements = [k for k in n.kids if k.kind == "element"]
        kinds: dict[tuple, list] = {}
        for k in elements:
            kinds.setdefault((k.name, k.ns == "html"), []).append(k)
        out: dict[int, tuple] = {}
        for same in kinds.values():
            for i, k in enumerate(same):
                out[id(k)] = (i + 1, len(same))
        return {id(k): (i + 1, len(elements), *out[id(k)]) for i, k in enumerate(elements)}

    # node, parent, host, path, tree, place among siblings, places of elements; None closes the node at its number
    work: list = [(doc, None, None, [], 0, 0, {})]
    while work:
        item = work.pop()
        if isinstance(item, int):
            rows[item][5] = len(rows) - 1
            continue
        n, parent, host, path, tree, at, around = item
        me = number[id(n)] = len(rows)
        tree = me if parent is None else tree
        element = n.kind == "element"
        e, ec, t, tc = around.get(id(n), (None,) * 4)
        attrs = n.attrs or []
        own = {name: v for ns, name, v in reversed(attrs) if not ns} if element else None
        cls = own.get("class") if element else None
        rows.append(
            [
                page_id,
                me,
                parent,
                tree,
                len(path),
                me,
                path,
                n.kind,
                n.ns or None,
                n.name or None,
                n.name.lower() if element else None,
                n.data if n.kind in ("text", "comment", "pi") else None,
                own.get("id") if element else None,
                (cls.split() if cls else []) if element else None,
                list(own.items()) if element else None,
                [tuple(a) for a in attrs] if element else None,
                at,
                e,
                ec,
                t,
                tc,
                element and n.parent is not None and n.parent.kind == "document",
                element and not any(k.kind in ("element", "text") for k in n.kids),
                host,
                quirks if n.kind == "document" else None,
                n.extra[0] if n.kind == "shadow" else None,
            ]
        )
        work.append(me)
        below = [*path, me]
        inner = places(n)
        work += [(k, me, None, below, tree, i, inner) for i, k in reversed(list(enumerate(n.kids)))]
        if n.content is not None and n.content.kind == "fragment":
            work.append((n.content, None, me, [], 0, 0, {}))
        if n.shadow is not None:
            work.append((n.shadow, None, me, [], 0, 0, {}))
    yield from map(tuple, rows)


def parse_nodes(pages: DataFrame, options: Options | None = None, columns: list[str] | None = None) -> DataFrame:
    """DOM nodes of page_id, html. A null page has no nodes. Only `columns` are built."""
    o = options or Options()

    def kernel(page_id: int, html: str | None) -> Iterator[tuple]:
        if html is not None:
            t = parse(html, o)
            yield from node_rows(page_id, t.doc, t.quirks)

    return flat_map(pages.select("page_id", "html"), kernel, schemas.NODES, columns)


def parse_fragments(fragments: DataFrame, options: Options | None = None, columns: list[str] | None = None) -> DataFrame:
    """Nodes of page_id, html, context_ns, context_name, each a fragment in its context; the root's children are the fragment."""
    o = options or Options()

    def kernel(page_id: int, html: str | None, ns: str, name: str) -> Iterator[tuple]:
        if html is not None:
            doc = Node("document")
            doc.add(parse_fragment(html, ns, name, o))
            yield from node_rows(page_id, doc)

    return flat_map(fragments.select("page_id", "html", "context_ns", "context_name"), kernel, schemas.NODES, columns)


def css_tokens(sheets: DataFrame) -> DataFrame:
    """CSS tokens of sheet_id, css."""

    def kernel(sheet_id: int, css: str | None) -> Iterator[tuple]:
        for i, t in enumerate(tokens(preprocess(css or ""))):
            yield sheet_id, i, t.kind, t.value, t.num, t.integer, t.unit, t.start, t.end

    return flat_map(sheets.select("sheet_id", "css"), kernel, schemas.CSS_TOKENS)


def _subject_key(selector) -> tuple[str, str]:
    key = ("universal", "")
    for s in selector[0][0]:
        if s[0] in ("id", "class"):
            return s[0], s[1]
        if s[0] == "type":
            key = ("tag", s[1].lower())
    return key


def parse_rules(sheets: DataFrame, env: Environment | None = None) -> DataFrame:
    """Selectors of the rules of sheet_id, css that apply in env, with specificity and what the subject asks for. Equal sheets are parsed once a worker."""
    e = env or Environment()

    def kernel(sheet_id: int, css: str | None) -> Iterator[tuple]:
        for r, (selectors, _) in enumerate(parse_sheet(css or "", e)):
            for i, c in enumerate(selectors):
                yield sheet_id, r, i, None, *specificity(c), *_subject_key(c)

    return flat_map(sheets.select("sheet_id", "css"), kernel, schemas.RULES)


def _declaration_row(i: int, d) -> tuple:
    longhands = [(n, v[0], format_value(v)) for n, v in d.data] if d.what == "longhands" else [(n, d.what, d.value) for n in (d.data[1:] if d.what == "wide" else d.data)]
    return i, d.name, d.value, d.important, d.what, longhands


def parse_rule_declarations(sheets: DataFrame, env: Environment | None = None) -> DataFrame:
    """Declarations of the rules of sheet_id, css that apply in env, with the longhands they set."""
    e = env or Environment()

    def kernel(sheet_id: int, css: str | None) -> Iterator[tuple]:
        for r, (_, declarations) in enumerate(parse_sheet(css or "", e)):
            for i, d in enumerate(declarations):
                yield sheet_id, r, *_declaration_row(i, d)

    return flat_map(sheets.select("sheet_id", "css"), kernel, schemas.DECLARATIONS)


def parse_style_attributes(attributes: DataFrame) -> DataFrame:
    """Declarations of sheet_id, css where css is a style attribute; rule is 0."""

    def kernel(sheet_id: int, css: str | None) -> Iterator[tuple]:
        for i, d in enumerate(parse_declarations(preprocess(css or ""))):
            yield sheet_id, 0, *_declaration_row(i, d)

    return flat_map(attributes.select("sheet_id", "css"), kernel, schemas.DECLARATIONS)


def parse_properties(declarations: DataFrame) -> DataFrame:
    """Longhands of case_id, property, value; none if the value is invalid."""

    def kernel(case_id: int, name: str, value: str) -> Iterator[tuple]:
        from ..kernels.css_syntax import parse_values

        for n, v in parse_property(name, parse_values(preprocess(value))) or ():
            yield case_id, n, v[0], format_value(v)

    return flat_map(declarations.select("case_id", "property", "value"), kernel, "case_id long, longhand string, kind string, value string")


def author_sheets(nodes: DataFrame) -> DataFrame:
    """Texts of the style elements of the document tree: page_id, node_id, css, media. Templates and shadow trees are other trees; MathML has none."""
    styles = nodes.where((F.col("kind") == "element") & (F.col("name") == "style") & (F.col("ns") != "mathml") & (F.col("tree_root") == 0))
    kind = F.element_at("attrs", "type")
    styles = styles.where(kind.isNull() | (kind == "") | (F.lower(kind) == "text/css")).select("page_id", "node_id", F.element_at("attrs", "media").alias("media"))
    texts = nodes.where(F.col("kind") == "text").select("page_id", F.col("parent_id").alias("node_id"), "child_idx", "text")
    joined = styles.join(texts, ["page_id", "node_id"], "left").groupBy("page_id", "node_id", "media")
    css = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("child_idx", "text")))), lambda x: x["text"]), "")
    return joined.agg(css.alias("css")).select("page_id", "node_id", "css", "media")


def compute_styles(pages: DataFrame, env: Environment | None = None, properties: list[str] | None = None, options: Options | None = None, tags: list[str] | None = None) -> DataFrame:
    """Computed values of the elements of page_id, html: one row for each of `properties` (all 39 by default) of each element (of `tags`, if given).

    Parsing, cascade and inheritance of a page are one step of one narrow pass; node_id is that of parse_nodes()."""
    e, o, wanted = env or Environment(), options or Options(), properties or list(PROPERTIES)

    def kernel(page_id: int, html: str | None) -> Iterator[tuple]:
        if html is None:
            return
        t = parse(html, o)
        styles = Styles(t.doc, e)
        for i, n in enumerate(_in_order(t.doc)):
            s = styles.of.get(id(n)) if n.kind == "element" and (tags is None or n.name in tags) else None
            for p in wanted if s is not None else ():
                v = s.values.get(p, ("custom", ""))
                px = v[1] if v[0] == "px" else v[2] if v[0] == "calc" else None
                yield page_id, i, p, v[0], px, v[1] if v[0] in ("pct", "calc") else None, float(v[1]) if v[0] in ("num", "int") else None, s.resolved(p)

    return flat_map(pages.select("page_id", "html"), kernel, schemas.COMPUTED)


def numbered(doc: Node) -> dict[int, int]:
    """Numbers of nodes in node_rows(), by id() of the node."""
    return {id(n): i for i, n in enumerate(_in_order(doc))}


def _in_order(doc: Node) -> Iterator[Node]:
    """Nodes in the order of their numbers in node_rows()."""
    work = [doc]
    while work:
        n = work.pop()
        yield n
        work += reversed(n.kids)
        if n.content is not None and n.content.kind == "fragment":
            work.append(n.content)
        if n.shadow is not None:
            work.append(n.shadow)


def layout_boxes(pages: DataFrame, env: Environment | None = None, fonts: list[Font | FontFile] | None = None, options: Options | None = None, columns: list[str] | None = None) -> DataFrame:
    """Boxes of page_id, html in the viewport of env: border boxes in x, y, w, h, edges as top, right, bottom, left. Without fonts text has no width.

    Fonts go to each executor once; of font files (kernels.font.described) only those that pages ask for are parsed, once a process."""
    e, o = env or Environment(), options or Options()
    sent = pages.sparkSession.sparkContext.broadcast(list(fonts or []))

    def kernel(page_id: int, html: str | None) -> Iterator[tuple]:
        if html is None:
            return
        t = parse(html, o)
        number = numbered(t.doc)
        root = Layout(Styles(t.doc, e), Faces(sent.value)).root
        work = [(root, None)] if root is not None else []
        count = 0
        while work:
            b, parent = work.pop()
            me, count = count, count + 1
            yield page_id, me, parent, number.get(id(b.node)) if b.node is not None else None, b.kind, b.node.name if b.node is not None and b.kind != "text" else None, *b.border_box(), list(b.margin), list(b.border), list(b.padding)
            work += [(k, me) for k in reversed(b.kids)]

    return flat_map(pages.select("page_id", "html"), kernel, schemas.BOXES, columns)


def read_fonts(spark: SparkSession, path: str) -> DataFrame:
    """Files below path that hold fonts: path and content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{ttf,otf,ttc,TTF,OTF,TTC}").option("recursiveFileLookup", True).load(path).select("path", "content")


def font_faces(files: DataFrame) -> DataFrame:
    """Faces of font files (path, content); what can't be read is left out."""

    def kernel(path: str, content: bytes) -> Iterator[tuple]:
        for i, f in enumerate(faces_of(bytes(content))):
            yield path, i, f.family, f.subfamily, f.weight, f.italic, f.units_per_em, f.ascender, f.descender, f.line_gap, len(f.advances)

    return flat_map(files.select("path", "content"), kernel, schemas.FACES)

