import random

import pytest

from pagelake import fixtures
from pagelake.kernels.css_media import Environment
from pagelake.kernels import font as font_kernel
from pagelake.kernels.font import BadFont, Faces, Font, described, faces_of
from pagelake.kernels.html_tree import Options, descendants, parse
from pagelake.kernels.layout import Layout
from pagelake.kernels.style import Styles

WINDOW = Environment(width=800.0, height=600.0)


def boxes(html, tag, fonts=()):
    doc = parse(html).doc
    rects = Layout(Styles(doc, WINDOW), Faces(list(fonts))).rects()
    return [tuple(round(v, 6) for v in rects[id(n)]) for n in descendants(doc) if n.kind == "element" and n.name == tag and id(n) in rects]


@pytest.mark.parametrize("html,tag,want", fixtures.LAYOUTS)
def test_blocks(html, tag, want):
    assert boxes(html, tag) == want


def style(html, tag, name, options=None, env=None):
    doc = parse(html, options or Options()).doc
    s = Styles(doc, env or Environment())
    return [s.of[id(n)].resolved(name) for n in descendants(doc) if n.kind == "element" and n.name == tag and id(n) in s.of]


def test_cascade():
    assert style("<style>p{opacity:.1} #a{opacity:.2} p.b{opacity:.3!important}</style><p id=a class=b style='opacity:.4'>", "p", "opacity") == ["0.3"]
    assert style("<style>b{font-weight:inherit} i{font-weight:bolder}</style><b>x<i>y<i>z", "i", "font-weight") == ["700", "900"]
    assert style("<p style='font-size:2em;margin-left:2em;line-height:150%'>", "p", "margin-left") == ["64px"]
    assert style("<p style='font-size:2em;line-height:1.5'>", "p", "line-height") == ["48px"]
    assert style("<code>x", "code", "font-size") == ["13px"] and style("<code style='font-family:monospace,serif'>", "code", "font-size") == ["16px"]
    assert style("<h1><small>x", "small", "font-size") == ["26.6667px"]
    assert style("<style>p{width:var(--w, 3px)} q{--w:7px;width:var(--w)} i{float:left;position:fixed}</style><p><q><i>", "p", "width") == ["3px"]
    assert style("<style>i{float:left;position:fixed}</style><i>", "i", "float") == ["none"] and style("<i style=float:left>", "i", "display") == ["block"]
    assert style("<style>@media print{p{top:1px}} @supports (display:flex){p{left:2px}} @layer x{p{right:3px}} a:link,p{bottom:4px}</style><p>", "p", "left") == ["2px"]
    assert style("<style>a:link,p{bottom:4px}</style><p>", "p", "bottom") == ["auto"]
    assert style("<div style='overflow-x:hidden'>", "div", "overflow-y") == ["auto"]
    assert style("<div style='border:thin solid'>", "div", "border-top-width", env=Environment(resolution=2.0)) == ["1px"]
    assert style("<template><style>p{top:9px}</style></template><p>", "p", "top") == ["auto"]
    assert style("<p style='--x: 1 2'>", "p", "--x") == ["1 2"]
    shadow = Options(declarative_shadow_roots=True)
    assert style(fixtures.SLOTTED, "div", "display", shadow) == ["flex"] and style(fixtures.SLOTTED, "s", "display", shadow) == []


def face(**more):
    return Font.synthetic("Times", {c: 500 for c in "abcdefghijklmnopqrstuvwxyz "}, **more)


def test_lines():
    page = "<!doctype html><body style='margin:0'><p style='margin:0;width:{}px'><i>aa bb</i> cc"
    assert boxes(page.format(1000), "i", [face()]) == [(0.0, 0.0, 40.0, 18.0)]
    assert boxes(page.format(30), "i", [face()])[0][3] == 36.0
    assert boxes(page.format(1000), "p", [face()])[0][3] == 18.0
    assert boxes("<!doctype html><p>  \n </p>", "p", [face()])[0][3] == 0.0
    assert boxes("<!doctype html><body style='margin:0'><i>ab", "i", [face(pairs={("a", "b"): -250})])[0][2] == 12.0


def table_font(kern=False):
    return fixtures.font_file(kern)


def test_font_files():
    f = Font.parse(table_font())
    assert (f.family, f.weight, f.units_per_em, f.advances, f.glyph("a"), f.glyph("b"), f.glyph("c")) == ("Face", 700, 1000, [100, 600, 600], 1, 2, 0)
    assert f.text_width("ab", 10) == 12.0 and f.line_metrics(10) == (8, 2, 1)
    assert Font.parse(table_font(True)).kerned_advances("ab") == [550, 600]
    assert Font.parse(fixtures.font_file(True, True)).kerned_advances("ab") == [530, 600]  # GPOS goes before kern
    with pytest.raises(BadFont):
        Font.parse(b"\0\1\0\0")
    assert faces_of(b"no font at all") == [] and faces_of(b"") == []


def test_font_files_are_loaded_when_asked_for():
    files = described(fixtures.font_file(kern=True)) + described(fixtures.font_file(bold=False, family="Other")) + described(b"junk")
    assert [(f.family, f.weight) for f in files] == [("Face", 700), ("Other", 400)]
    faces = Faces([*files, *described(fixtures.font_file(family="Cut")[:-40])])
    font_kernel._loaded.clear()
    assert faces.query("face", 400).kerned_advances("ab") == [550, 600] and len(font_kernel._loaded) == 1
    assert faces.query("none", 400) is None and Faces(files).query("Face", 700) is faces.query("Face", 400)


def test_damaged_fonts_never_crash():
    rng, good = random.Random(1), fixtures.font_file(True, True)
    for _ in range(2000):
        raw = bytearray(good)
        for _ in range(rng.randrange(1, 6)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        for f in faces_of(bytes(raw[: rng.randrange(len(raw) + 1)] if rng.random() < 0.3 else raw)):
            f.kerned_width("ab", 12)


def test_random_pages_are_laid_out():
    rng = random.Random(2)
    bits = ["<div>", "</div>", "<p>", "<b>", "</b>", "text ", "<table><tr><td>", "</table>", "<ul><li>", "<span style='display:none'>", "<div style='width:50%;margin:-5px auto;padding:3%'>", "<div style='height:50%;min-height:20px;display:flex'>", "<i style='display:contents'>", "\n"]
    for _ in range(150):
        doc = parse("".join(rng.choice(bits) for _ in range(40))).doc
        for r in Layout(Styles(doc, WINDOW), Faces([face()])).rects().values():
            assert all(abs(v) < 1e7 for v in r)
