import random

import pytest

from pagelake import fixtures
from pagelake.catalog import short_dump
from pagelake.kernels.html_lexer import decode, tokenize
from pagelake.kernels.html_tree import Options, dump, parse, parse_fragment


@pytest.mark.parametrize("html,tree", fixtures.TREES)
def test_trees(html, tree):
    assert short_dump(parse(html).doc) == tree


@pytest.mark.parametrize("ns,name,html,tree", fixtures.FRAGMENTS)
def test_fragments(ns, name, html, tree):
    assert short_dump(parse_fragment(html, ns, name)) == tree


@pytest.mark.parametrize("html,tree", fixtures.SHADOWS)
def test_shadow_roots(html, tree):
    assert short_dump(parse(html, Options(declarative_shadow_roots=True)).doc) == tree


@pytest.mark.parametrize("raw,text,value", fixtures.REFERENCES)
def test_references(raw, text, value):
    assert decode(raw) == text and decode(raw, attribute=True) == value


def test_tokens():
    assert tokenize("<A b='1' B=2 c/>x</a ><!-->") == [("start", "a", [("b", "1"), ("c", "")], True), ("text", "x"), ("end", "a", [], False), ("comment", ""), ("eof",)]
    assert tokenize("<a b=\"") == [("eof",)]
    assert tokenize("<a b=>c") == [("start", "a", [("b", "")], False), ("text", "c"), ("eof",)]
    assert tokenize("<a =b=c/d>") == [("start", "a", [("=b", "c/d")], False), ("eof",)]
    assert tokenize("a\r\nb\r<")[0] == ("text", "a\nb\n<")
    assert tokenize("</><//x><!x><?x") == [("comment", "/x"), ("comment", "x"), ("eof",)]
    assert tokenize("<!DOCTYPE html PUBLIC 'a' \"b\">")[0] == ("doctype", "html", "a", "b", False)
    assert tokenize("<!doctype>")[0] == ("doctype", "", None, None, True)
    assert tokenize("<!doctype a system 'x>")[0] == ("doctype", "a", None, "x", True)
    assert tokenize("a</b>c</title >d", "rcdata", "title") == [("text", "a</b>c"), ("end", "title", [], False), ("text", "d"), ("eof",)]
    assert tokenize("&amp;<!--<script>x</script>--></script>", "script", "script")[0] == ("text", "&amp;<!--<script>x</script>-->")
    assert tokenize("a\0</p>", "plaintext") == [("text", "a�</p>"), ("eof",)]


def test_quirks():
    of = lambda s: parse(s).quirks
    assert of("<p>") == "quirks" and of("<!doctype html>") == "no-quirks"
    assert of('<!doctype html public "-//W3C//DTD HTML 4.01 Transitional//EN">') == "quirks"
    assert of('<!doctype html public "-//W3C//DTD HTML 4.01 Transitional//EN" "x">') == "limited-quirks"
    assert of('<!doctype html public "-//IETF//DTD HTML 2.0//EN">') == "quirks"
    assert of('<!doctype html public "-//W3C//DTD XHTML 1.0 Frameset//EN">') == "limited-quirks"


PIECES = "<b> </b> <i> <p> </p> <table> <tr> <td> </table> <caption> <svg> </svg> <math> <mi> <foreignobject> <select> <option> </select> <template> </template> <a> </a> <form> </form> <li> <ul> </ul> <h1> </h1> <button> <frameset> <script> </script> <style> </style> <title> </title> <textarea> </textarea> text &amp; &lt <!-- --> <br> </br> <body> </body> <html> </html> <head> <colgroup> <col> <tbody> <desc> <object> </object> <nobr> <ruby> <rt> <plaintext> <noscript> <div slot=x> <template shadowrootmode=open> \0 \n".split(" ")


def invariants(root):
    stack, seen = [root], set()
    while stack:
        n = stack.pop()
        assert id(n) not in seen
        seen.add(id(n))
        for k in n.kids:
            assert k.parent is n
            stack.append(k)
        for side in (n.content, n.shadow):
            if side is not None:
                stack.append(side)


@pytest.mark.parametrize("seed", range(6))
def test_random_pages_make_whole_trees(seed):
    rng = random.Random(seed)
    for _ in range(300):
        html = "".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 60)))
        o = Options(scripting=rng.random() < 0.5, declarative_shadow_roots=rng.random() < 0.5)
        t = parse(html, o)
        invariants(t.doc)
        dump(t.doc)
        invariants(parse_fragment(html, "html", rng.choice(["div", "table", "tr", "select", "template", "title", "body", "td", "svg"]), o))
        cut = html[: rng.randrange(len(html) + 1)]
        parse(cut)


def test_deep_pages():
    t = parse("<div>" * 20_000 + "x")
    invariants(t.doc)
    assert dump(t.doc).endswith('"x"')
