import math
import random

import pytest

from pagelake import fixtures
from pagelake.kernels.css_media import Environment, format_media, media_matches, parse_media, supports
from pagelake.kernels.css_selectors import parse_selectors, specificity
from pagelake.kernels.css_syntax import an_plus_b, block_contents, parse_rules, parse_values, preprocess, raw_declarations, to_css, tokens
from pagelake.kernels.css_values import compute_custom, format_color, format_number, format_value, parse_color, parse_property, substitute


@pytest.mark.parametrize("name,value,want", fixtures.PROPERTIES)
def test_properties(name, value, want):
    got = parse_property(name, parse_values(value))
    assert (None if got is None else {n: format_value(v) for n, v in got}) == want


@pytest.mark.parametrize("value,want", fixtures.COLORS)
def test_colors(value, want):
    c = parse_color(parse_values(value))
    assert (c and format_color(c)) == want


def test_color_5():
    assert format_color(parse_color(parse_values("#ff000080")), css5=True) == "color(srgb 1 0 0 / 0.501961)"


@pytest.mark.parametrize("query,text,matches", fixtures.MEDIA)
def test_media(query, text, matches):
    q = parse_media(query)
    assert (format_media(q), media_matches(q, Environment())) == (text, matches)


@pytest.mark.parametrize("condition,holds", fixtures.SUPPORTS)
def test_supports(condition, holds):
    assert supports(condition) is holds


@pytest.mark.parametrize("parent,style,name,want", fixtures.VARIABLES)
def test_variables(parent, style, name, want):
    of = lambda s: [(n, v) for n, v, _ in raw_declarations(preprocess(s))]
    assert compute_custom(of(style), compute_custom(of(parent), {})).get(name, "") == want


def test_substitution_is_bounded():
    style = "--a0: " + "x" * 1000 + ";" + ";".join(f"--a{i + 1}: var(--a{i}) var(--a{i})" for i in range(30))
    got = compute_custom([(n, v) for n, v, _ in raw_declarations(style)], {})
    assert "--a5" in got and "--a30" not in got
    assert substitute("var(--x, var(--y, 3))", {}) == "3" and substitute("var(--x)", {}) is None


@pytest.mark.parametrize("selector,want", fixtures.SPECIFICITIES)
def test_specificity(selector, want):
    got = parse_selectors(selector)
    assert (max(map(specificity, got)) if got else None) == want


@pytest.mark.parametrize("text,a,b", fixtures.NTH)
def test_nth(text, a, b):
    assert an_plus_b(parse_values(text)) == (None if a is None else (a, b))


def test_numbers():
    assert [format_number(v) for v in (100 / 3, 0.0, -0.0, 1e-9, 123456789.0, math.inf, -math.inf, math.nan)] == ["33.3333", "0", "0", "0.000000001", "123456789", "3.40282e+38", "-3.40282e+38", "0"]


def test_syntax():
    kinds = [t.kind for t in tokens("a#b 1.5e3px 20% url( x ) url('y') \"s\\41\" /*c*/ @m <!-- --> {[(")]
    assert kinds == ["ident", "hash", "ws", "dimension", "ws", "percentage", "ws", "url", "ws", "function", "string", ")", "ws", "string", "ws", "ws", "at", "ws", "cdo", "ws", "cdc", "ws", "{", "[", "("]
    assert tokens("'a\nb")[0].kind == "badstring" and tokens("url(a b)")[0].kind == "badurl"
    assert tokens("\\31 x")[0].value == "1x" and tokens("--")[0].kind == "ident" and tokens("-1")[0].kind == "number"
    assert preprocess("a\r\nb\fc\0") == "a\nb\nc�"
    assert raw_declarations("a: b; c:d!important; e; f: {;}; g : ") == [("a", "b", False), ("c", "d", True), ("f", "{;}", False), ("g", "", False)]
    rules = parse_rules("<!-- a{b:c} @media x{d{}} @import 'y'; z")
    assert [(r["kind"], r["name"], r["block"] is None) for r in rules] == [("style", None, False), ("at", "media", False), ("at", "import", True)]
    inner = block_contents(parse_values("color: red; &:hover{a:b} @x y; --c:{d} ; p q{r:s}"))
    assert [i["kind"] for i in inner] == ["declaration", "style", "at", "declaration", "style"]
    assert to_css(parse_values("a( 'b' ) [#c=1.0px]")) == 'a( "b" ) [#c=1.0px]'


@pytest.mark.parametrize("seed", range(4))
def test_random_sheets(seed):
    from pagelake.kernels.style import parse_sheet

    rng = random.Random(seed)
    bits = "a .b #c { } ( ) [ ] : ; , ! @media @supports @layer (width) not and important var( --x calc( 1px 50% + - / * \" ' \\ url( /* */ <!-- > ~ = ^= \n é".split(" ")
    for _ in range(500):
        css = " ".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))
        parse_sheet(css, Environment())
        parse_selectors(css)
        parse_media(css)
        parse_color(parse_values(css))
        for name in ("margin", "font", "border", "width", "display"):
            parse_property(name, parse_values(css))
