"""Selectors as relational plans over the table of nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..kernels.css_selectors import NO_CASE, Index, matches_list, parse_selectors, specificity
from ..kernels.html_lexer import ascii_lower
from ..kernels.html_tree import Options, descendants, parse
from ..session import flat_map
from .navigate import KEY, nth_matches


def _html() -> Column:
    return F.col("ns") == "html"


def _attribute(s: tuple) -> Column:
    _, name, op, wanted, flag = s
    low = ascii_lower(name)
    value = F.element_at("attrs", low) if low == name else F.when(_html(), F.element_at("attrs", low)).otherwise(F.element_at("attrs", name))
    if op is None:
        return value.isNotNull()

    def test(v: Column, w: str) -> Column:
        if op == "=":
            return v == w
        if op == "|=":
            return (v == w) | v.startswith(w + "-")
        if not w or (op == "~=" and any(c in w for c in " \t\n\f\r")):
            return F.lit(False)
        if op == "~=":
            return F.array_contains(F.split(v, r"[ \t\n\f\r]"), w)
        return {"^=": v.startswith, "$=": v.endswith, "*=": v.contains}[op](w)

    exact, loose = test(value, wanted), test(F.lower(value), ascii_lower(wanted))
    got = loose if flag == "i" else exact if flag == "s" else F.when(_html(), loose).otherwise(exact) if low in NO_CASE else exact
    return F.coalesce(got, F.lit(False))


def simple_predicate(s: tuple) -> Column | None:
    """A simple selector as a predicate on a row of nodes, or None if it needs a join."""
    kind = s[0]
    if kind == "*":
        return F.lit(True)
    if kind == "type":
        return F.when(_html(), F.col("name_lc") == ascii_lower(s[1])).otherwise(F.col("name") == s[1])
    if kind == "id":
        return F.coalesce(F.col("id") == s[1], F.lit(False))
    if kind == "class":
        return F.array_contains("classes", s[1])
    if kind == "attr":
        return _attribute(s)
    if kind == "state":
        return {
            "root": F.col("is_root"),
            "empty": F.col("is_empty"),
            "first-child": F.col("elem_idx") == 1,
            "last-child": F.col("elem_idx") == F.col("elem_count"),
            "only-child": F.col("elem_count") == 1,
            "first-of-type": F.col("type_idx") == 1,
            "last-of-type": F.col("type_idx") == F.col("type_count"),
            "only-of-type": F.col("type_count") == 1,
        }[s[1]]
    if kind == "nth" and s[5] is None:
        _, a, b, from_end, of_type, _ = s
        i, n = ("type_idx", "type_count") if of_type else ("elem_idx", "elem_count")
        return nth_matches(a, b, F.col(n) - F.col(i) + 1 if from_end else F.col(i))
    if kind in ("is", "where", "not"):
        inner = [_compound_predicate(c[0]) if not c[1] else None for c in s[1]]
        if any(p is None for p in inner):
            return None
        some = reduce(lambda x, y: x | y, inner, F.lit(False))
        return ~some if kind == "not" else some
    if kind in ("never", "host"):
        return F.lit(False)
    return None


def _compound_predicate(compound: tuple) -> Column | None:
    simples, pseudo = compound
    if pseudo is not None:
        return F.lit(False)
    parts = [simple_predicate(s) for s in simples]
    return None if any(p is None for p in parts) else reduce(lambda x, y: x & y, parts, F.lit(True))


def _filter(nodes: DataFrame, compound: tuple) -> DataFrame:
    """Rows of nodes that a compound fits; what no predicate can tell is a semi or anti join or a window."""
    simples, pseudo = compound
    if pseudo is not None:
        return nodes.where(F.lit(False))
    out, later = nodes, []
    for s in simples:
        p = simple_predicate(s)
        if p is None:
            later.append(s)
        else:
            out = out.where(p)
    for s in later:
        if s[0] == "nth":
            _, a, b, from_end, _, only = s
            w = Window.partitionBy("page_id", "parent_id").orderBy(F.desc("child_idx") if from_end else F.asc("child_idx"))
            good = _matching(nodes, only).withColumn("_n", F.row_number().over(w)).where(nth_matches(a, b, F.col("_n"))).select(*KEY)
            out = out.join(good, KEY, "left_semi")
        else:
            out = out.join(_matching(nodes, s[1]).select(*KEY), KEY, "left_anti" if s[0] == "not" else "left_semi")
    return out


def _matching(nodes: DataFrame, selectors: list) -> DataFrame:
    """Rows of nodes that any of the selectors fits, each once."""
    whole = [_compound_predicate(c[0]) if not c[1] else None for c in selectors]
    flat = [p for p in whole if p is not None]
    parts = [nodes.where(reduce(lambda x, y: x | y, flat))] if flat else []
    parts += [_complex(nodes, c) for c, p in zip(selectors, whole, strict=True) if p is None]
    if not parts:
        return nodes.where(F.lit(False))
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).dropDuplicates(KEY)


def _complex(nodes: DataFrame, selector: tuple) -> DataFrame:
    """From the leftmost compound on, each combinator is a semi join on equal keys."""
    subject, rest = selector
    chain = [(None, rest[-1][1]), *[(rest[i][0], rest[i - 1][1]) for i in range(len(rest) - 1, 0, -1)], (rest[0][0], subject)] if rest else [(None, subject)]
    found = _filter(nodes, chain[0][1])
    for join, compound in chain[1:]:
        right = _filter(nodes, compound)
        if join == " ":
            up = right.select(*KEY, F.explode("path").alias("_up"))
            left = found.select("page_id", F.col("node_id").alias("_up"))
            found = right.join(up.join(left, ["page_id", "_up"], "left_semi").select(*KEY), KEY, "left_semi")
        elif join == ">":
            found = right.join(found.select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"], "left_semi").select(*nodes.columns)
        elif join == "+":
            left = found.select("page_id", "parent_id", (F.col("elem_idx") + 1).alias("elem_idx"))
            found = right.join(left, ["page_id", "parent_id", "elem_idx"], "left_semi").select(*nodes.columns)
        else:
            left = found.groupBy("page_id", "parent_id").agg(F.min("elem_idx").alias("_first"))
            found = right.join(left, ["page_id", "parent_id"]).where(F.col("elem_idx") > F.col("_first")).select(*nodes.columns)
    return found


def select(nodes: DataFrame, selector: str, tree_root: int | None = 0) -> DataFrame:
    """Rows of nodes (with all columns of the kernel) that a selector list fits, in the document tree. An invalid list raises ValueError."""
    parsed = parse_selectors(selector)
    if parsed is None:
        raise ValueError(f"invalid selector: {selector}")
    e = nodes.where("kind = 'element'")
    e = e if tree_root is None else e.where(F.col("tree_root") == tree_root)
    return _matching(e, parsed)


def needs_joins(selectors: list) -> bool:
    """Whether some selector of a list is more than a predicate on a row of nodes."""
    return any(rest or _compound_predicate(compound) is None for compound, rest in selectors)


def select_from_pages(pages: DataFrame, selector: str, options: Options | None = None, columns: list[str] | None = None) -> DataFrame:
    """What select() finds in pages of page_id, html, from one pass over them and without a shuffle.

    A list of plain predicates is a filter on parsed nodes. For anything else the kernel matches while it has the page's tree, and only rows
    that fit are built and sent; select() is there for nodes that are a table already."""
    from ..sources.pages import node_rows, numbered, parse_nodes

    parsed = parse_selectors(selector)
    if parsed is None:
        raise ValueError(f"invalid selector: {selector}")
    if not needs_joins(parsed):
        found = select(parse_nodes(pages, options), selector)
        return found if columns is None else found.select(*columns)
    o = options or Options()

    def kernel(page_id: int, html: str | None):
        if html is not None:
            built = parse(html, o)
            ix = Index()
            number = numbered(built.doc)
            wanted = {number[id(n)] for n in descendants(built.doc) if n.kind == "element" and matches_list(parsed, n, ix)}
            if wanted:
                yield from (r for i, r in enumerate(node_rows(page_id, built.doc, built.quirks)) if i in wanted)

    return flat_map(pages.select("page_id", "html"), kernel, schemas.NODES, columns)


def select_by_kernel(pages: DataFrame, selector: str) -> DataFrame:
    """page_id, node_id of what select() finds, told by the kernel page by page: the other way to the same result."""
    from ..sources.pages import numbered

    parsed = parse_selectors(selector)
    if parsed is None:
        raise ValueError(f"invalid selector: {selector}")

    def kernel(page_id: int, html: str | None):
        if html is not None:
            doc = parse(html).doc
            number = numbered(doc)
            ix = Index()
            for n in descendants(doc):
                if n.kind == "element" and matches_list(parsed, n, ix):
                    yield page_id, number[id(n)]

    return flat_map(pages.select("page_id", "html"), kernel, "page_id long, node_id int")


def specificities(cases: DataFrame) -> DataFrame:
    """(case_id, valid, a, b, c) of case_id, selector: the highest of a list."""

    def kernel(case_id: int, selector: str):
        got = parse_selectors(selector)
        yield case_id, got is not None, *(max(map(specificity, got)) if got else (None, None, None))

    return flat_map(cases.select("case_id", "selector"), kernel, "case_id long, valid boolean, a int, b int, c int")
