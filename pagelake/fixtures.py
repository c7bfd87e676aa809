"""Small literal cases with the results that the standards give. They stand for page features that the table pages lacks."""

from __future__ import annotations

import struct

# (html, dump of the tree with lines joined by "/", without indentation bars): one or more for each insertion mode.
TREES = (
    ("<b>1<p>2</b>3</p>", "<html>/ <head>/ <body>/  <b>/   \"1\"/  <p>/   <b>/    \"2\"/   \"3\""),
    ("<table><b>x<tr><td>y</table>z", "<html>/ <head>/ <body>/  <b>/   \"x\"/  <table>/   <tbody>/    <tr>/     <td>/      \"y\"/  <b>/   \"z\""),
    ("<table>a<caption>c<td>d", "<html>/ <head>/ <body>/  \"a\"/  <table>/   <caption>/    \"c\"/   <tbody>/    <tr>/     <td>/      \"d\""),
    ("<table><colgroup><col>x", "<html>/ <head>/ <body>/  \"x\"/  <table>/   <colgroup>/    <col>"),
    ("<svg viewbox=1><foreignobject><p>q</p></foreignobject></svg>z", "<html>/ <head>/ <body>/  <svg svg>/   viewBox=\"1\"/   <svg foreignObject>/    <p>/     \"q\"/  \"z\""),
    ("<svg><g><div>x", "<html>/ <head>/ <body>/  <svg svg>/   <svg g>/  <div>/   \"x\""),
    ("<math><mi><b>x", "<html>/ <head>/ <body>/  <math math>/   <math mi>/    <b>/     \"x\""),
    ("<svg><a xlink:href=u>t", "<html>/ <head>/ <body>/  <svg svg>/   <svg a>/    xlink href=\"u\"/    \"t\""),
    ("<template><tr><td>x</template>", "<html>/ <head>/  <template>/   content/    <tr>/     <td>/      \"x\"/ <body>"),
    ("<frameset><frame><noframes>n</noframes></frameset>", "<html>/ <head>/ <frameset>/  <frame>/  <noframes>/   \"n\""),
    ("<select><option>a<optgroup><option>b</select>", "<html>/ <head>/ <body>/  <select>/   <option>/    \"a\"/   <optgroup>/    <option>/     \"b\""),
    ("x</p>y</br>z", "<html>/ <head>/ <body>/  \"x\"/  <p>/  \"y\"/  <br>/  \"z\""),
    ("<p>a<table><tr><td>b", "<html>/ <head>/ <body>/  <p>/   \"a\"/   <table>/    <tbody>/     <tr>/      <td>/       \"b\""),
    ("<!doctype html><p>a<table>", "<!DOCTYPE html>/<html>/ <head>/ <body>/  <p>/   \"a\"/  <table>"),
    ("<title>a&amp&lt;</title><script><!--<script></script>--></script>", "<html>/ <head>/  <title>/   \"a&<\"/  <script>/   \"<!--<script></script>-->\"/ <body>"),
    ("<pre>\n\nx</pre><image>", "<html>/ <head>/ <body>/  <pre>/   \"\nx\"/  <img>"),
    ("<?php echo?><?xml v?>", "<?php echo?>/<!-- ?xml v? -->/<html>/ <head>/ <body>"),
    ("<ul><li>a<li>b</ul><dl><dt>c<dd>d", "<html>/ <head>/ <body>/  <ul>/   <li>/    \"a\"/   <li>/    \"b\"/  <dl>/   <dt>/    \"c\"/   <dd>/    \"d\""),
    ("<a href=1>x<a href=2>y", "<html>/ <head>/ <body>/  <a>/   href=\"1\"/   \"x\"/  <a>/   href=\"2\"/   \"y\""),
    ("<b><b><b><b>x<p>y", "<html>/ <head>/ <body>/  <b>/   <b>/    <b>/     <b>/      \"x\"/      <p>/       \"y\""),
    ("<body a=1><body a=2 b=3><html c=4>", "<html>/ c=\"4\"/ <head>/ <body>/  a=\"1\"/  b=\"3\""),
    ("<ruby>a<rb>b<rt>c<rp>d", "<html>/ <head>/ <body>/  <ruby>/   \"a\"/   <rb>/    \"b\"/   <rt>/    \"c\"/   <rp>/    \"d\""),
    ("<button>a<button>b<form>c<form>d", "<html>/ <head>/ <body>/  <button>/   \"a\"/  <button>/   \"b\"/   <form>/    \"cd\""),
    ("<h1>a<h2>b</h3>c", "<html>/ <head>/ <body>/  <h1>/   \"a\"/  <h2>/   \"b\"/  \"c\""),
    ("<!--a--!><!-->b--><!--c--", "<!-- a -->/<!--  -->/<html>/ <head>/ <body>/  \"b-->\"/  <!-- c -->"),
    ("<textarea>\n<b></textarea><plaintext></plaintext>", "<html>/ <head>/ <body>/  <textarea>/   \"<b>\"/  <plaintext>/   \"</plaintext>\""),
    ("a<noscript><p>b</noscript>", "<html>/ <head>/ <body>/  \"a\"/  <noscript>/   <p>/    \"b\""),
    ("</body></html> <!--x-->", "<html>/ <head>/ <body>/  \" \"/<!-- x -->"),
    ("<p a=1 A=2 b>x", "<html>/ <head>/ <body>/  <p>/   a=\"1\"/   b=\"\"/   \"x\""),
    ("<svg><![CDATA[<b>&amp;]]>]]></svg>", "<html>/ <head>/ <body>/  <svg svg>/   \"<b>&amp;]]>\""),
    ("<noscript><link rel=x><style>a</style></noscript><p>", "<html>/ <head>/  <noscript>/   <link>/    rel=\"x\"/   <style>/    \"a\"/ <body>/  <p>"),
    ("<head><noscript><b>x", "<html>/ <head>/  <noscript>/ <body>/  <b>/   \"x\""),
    ("<section><span><em>a</span>b", "<html>/ <head>/ <body>/  <section>/   <span>/    <em>/     \"a\"/   <em>/    \"b\""),
    ("<p><ins>a</del>b", "<html>/ <head>/ <body>/  <p>/   <ins>/    \"ab\""),
    ("<div><p>a</div>b</p>c", "<html>/ <head>/ <body>/  <div>/   <p>/    \"a\"/  \"b\"/  <p>/  \"c\""),
    ("<select><button><selectedcontent></selectedcontent></button><option>a<option selected>b</select>", "<html>/ <head>/ <body>/  <select>/   <button>/    <selectedcontent>/     \"b\"/   <option>/    \"a\"/   <option>/    selected=\"\"/    \"b\""),
    ("<i>a<b>b<div>c</b>d", "<html>/ <head>/ <body>/  <i>/   \"a\"/   <b>/    \"b\"/   <div>/    <b>/     \"c\"/    \"d\""),
    ("<table><tr><th>a<td>b</table>", "<html>/ <head>/ <body>/  <table>/   <tbody>/    <tr>/     <th>/      \"a\"/     <td>/      \"b\""),
    ("<p>a<hr>b<address>c", "<html>/ <head>/ <body>/  <p>/   \"a\"/  <hr>/  \"b\"/  <address>/   \"c\""),
    ("<style><!--</style>x", "<html>/ <head>/  <style>/   \"<!--\"/ <body>/  \"x\""),
    ("<math><annotation-xml encoding=text/html><p>x</math>", "<html>/ <head>/ <body>/  <math math>/   <math annotation-xml>/    encoding=\"text/html\"/    <p>/     \"x\""),
)

# (context namespace, context, html, dump of the fragment)
FRAGMENTS = (
    ("html", "div", "<p>a<p>b", "<p>/ \"a\"/<p>/ \"b\""),
    ("html", "title", "<b>&amp;", "\"<b>&\""),
    ("html", "table", "<td>x", "<tbody>/ <tr>/  <td>/   \"x\""),
    ("html", "tr", "<td>x</td></tr>y", "<td>/ \"x\"/\"y\""),
    ("html", "select", "<input><option>a", "<option>/ \"a\""),
    ("svg", "svg", "<g/><p>x", "<svg g>/<p>/ \"x\""),
    ("html", "template", "<tr><td>x", "<tr>/ <td>/  \"x\""),
)

# (html, dump with declarative shadow roots)
SHADOWS = (
    ("<div><template shadowrootmode=open><slot></slot></template>x</div>", "<html>/ <head>/ <body>/  <div>/   #shadow-root (open)/    <slot>/   \"x\""),
    ("<p><template shadowrootmode=closed><b>y</template>", "<html>/ <head>/ <body>/  <p>/   #shadow-root (closed)/    <b>/     \"y\""),
    ("<img><ul><template shadowrootmode=open>z</template></ul>", "<html>/ <head>/ <body>/  <img>/  <ul>/   <template>/    shadowrootmode=\"open\"/    content/     \"z\""),
    ("<x-a><template shadowrootmode=OPEN>q</template><template shadowrootmode=open>r</template></x-a>", "<html>/ <head>/ <body>/  <x-a>/   #shadow-root (open)/    \"q\"/   <template>/    shadowrootmode=\"open\"/    content/     \"r\""),
)

# (text with references, as text, as the value of an attribute)
REFERENCES = (
    ("&amp;&lt;&copy", "&<©", "&<©"),
    ("&ampx &amp=1", "&x &=1", "&ampx &amp=1"),
    ("&notin; &notit;", "∉ ¬it;", "∉ &notit;"),
    ("&#65;&#x42;&#0;&#x110000;&#xD800;", "AB���", "AB���"),
    ("&#128;&#150;&#x99", "€–™", "€–™"),
    ("&bogus; &; & &#; &#x;", "&bogus; &; & &#; &#x;", "&bogus; &; & &#; &#x;"),
    ("&CounterClockwiseContourIntegral;", "∳", "∳"),
)

# (selector, highest specificity or None if invalid)
SPECIFICITIES = (
    ("*", (0, 0, 0)), ("li", (0, 0, 1)), ("ul li", (0, 0, 2)), ("ul ol+li", (0, 0, 3)), ("h1 + *[rel=up]", (0, 1, 1)), ("ul ol li.red", (0, 1, 3)),
    ("#x34y", (1, 0, 0)), ("#s12:not(foo)", (1, 0, 1)), (".foo :is(.bar, #baz)", (1, 1, 0)), (":where(#a, .b) p", (0, 0, 1)), ("li:nth-child(2 of .x)", (0, 2, 1)),
    ("p::before", (0, 0, 2)), (":host(.a)", (0, 2, 0)), ("a:hover, #b", (1, 0, 0)), ("p:unknown", None), ("div >", None), ("a|b", None), (":not()", None),
    ("[a=]", None), ("p::before b", None), (":is(p, :unknown)", (0, 0, 1)), ("li:nth-child(2n+x)", None),
)

# (text, a, b) of An+B
NTH = (("odd", 2, 1), ("even", 2, 0), ("2n+1", 2, 1), ("-n+3", -1, 3), ("n", 1, 0), ("+n", 1, 0), ("4", 0, 4), ("-3n - 2", -3, -2), ("2n + 0", 2, 0), ("+ 2n", None, None), ("2 n", None, None), ("foo", None, None), ("n+-1", None, None), ("1.5n", None, None))

# (property, value, {longhand: value} or None if invalid)
PROPERTIES = (
    ("margin", "1px 2em", {"margin-top": "1px", "margin-right": "2em", "margin-bottom": "1px", "margin-left": "2em"}),
    ("padding", "-1px", None),
    ("width", "calc(100% - 2 * 10px)", {"width": "calc(100% - 20px)"}),
    ("width", "calc(1px+2px)", None),
    ("height", "1in", {"height": "1in"}),
    ("top", "0", {"top": "0px"}),
    ("left", "5", None),
    ("display", "inline math", {"display": "math"}),
    ("opacity", "50%", {"opacity": "0.5"}),
    ("z-index", "1.0", None),
    ("z-index", "-7", {"z-index": "-7"}),
    ("border-top", "red", {"border-top-width": "medium", "border-top-style": "none"}),
    ("border-left", "2px solid #fff", {"border-left-width": "2px", "border-left-style": "solid"}),
    ("border-right", "solid solid", None),
    ("overflow", "hidden clip", {"overflow-x": "hidden", "overflow-y": "clip"}),
    ("font", "italic bold 12px/1.5 Times New Roman, serif", {"font-size": "12px", "font-weight": "bold", "line-height": "1.5", "font-family": "Times New Roman, serif"}),
    ("font", "12px", None),
    ("font-family", '"A b", c inherit', None),
    ("font-weight", "1001", None),
    ("line-height", "-1", None),
    ("min-width", "none", None),
    ("max-width", "fit-content", {"max-width": "fit-content"}),
    ("color", "red", None),
    ("width", "calc((1em + 2px) * 3)", {"width": "calc(3em + 6px)"}), ("width", "calc(10px / 0)", None), ("width", "calc(2 * 3)", None), ("width", "calc(1px * 1px)", None), ("width", "calc(50% - -1px)", {"width": "calc(50% + 1px)"}),
    ("margin-top", "calc(1in + 1px)", {"margin-top": "calc(97px)"}), ("padding", "1px 2px 3px 4px 5px", None), ("padding", "1px 2px 3px", {"padding-top": "1px", "padding-right": "2px", "padding-bottom": "3px", "padding-left": "2px"}),
    ("border-width", "thin 0", {"border-top-width": "thin", "border-right-width": "0px", "border-bottom-width": "thin", "border-left-width": "0px"}), ("border-style", "solid none", {"border-top-style": "solid", "border-right-style": "none", "border-bottom-style": "solid", "border-left-style": "none"}),
    ("border", "none", {f"border-{s}-{k}": {"width": "medium", "style": "none"}[k] for s in ("top", "right", "bottom", "left") for k in ("width", "style")}), ("border", "1px 2px", None), ("display", "block math", {"display": "block math"}), ("display", "block inline", None),
    ("position", "STICKY", {"position": "sticky"}), ("float", "inline-start", {"float": "inline-start"}), ("visibility", "collapse", {"visibility": "collapse"}), ("overflow", "scroll", {"overflow-x": "scroll", "overflow-y": "scroll"}), ("opacity", "2", {"opacity": "2"}),
    ("font-weight", "350.5", {"font-weight": "350.5"}), ("font-size", "xxx-large", {"font-size": "xxx-large"}), ("font-size", "-1px", None), ("line-height", "120%", {"line-height": "120%"}), ("z-index", "auto", {"z-index": "auto"}), ("top", "1e2px", {"top": "100px"}), ("left", "1unit", None),
    ("font", "small-caps 1em serif", {"font-size": "1em", "font-weight": "normal", "line-height": "normal", "font-family": "serif"}), ("font", "bold italic oblique normal small-caps 1em serif", None), ("box-sizing", "border-box", {"box-sizing": "border-box"}), ("max-height", "auto", None),
)

# (color, serialised or None)
COLORS = (
    ("red", "rgb(255, 0, 0)"), ("#0f08", "rgba(0, 255, 0, 0.533333)"), ("transparent", "rgba(0, 0, 0, 0)"), ("currentColor", "currentcolor"), ("rgb(10% 20% 30% / 50%)", "rgba(25.5, 51, 76.5, 0.5)"),
    ("rgb(1, 2%, 3)", None), ("hsl(120 100% 50%)", "rgb(0, 255, 0)"), ("hwb(0 50% 50%)", "rgb(127.5, 127.5, 127.5)"), ("lab(50% 40 none)", "lab(50 40 none)"),
    ("oklch(0.5 50% 400deg)", "oklch(0.5 0.2 40)"), ("color(xyz 1 0 50%)", "color(xyz-d65 1 0 0.5)"), ("color(--x 1)", "color(--x 1)"), ("device-cmyk(0 1 2 0)", "color(device-cmyk 0 1 1 0)"),
    ("light-dark(red, #000)", "light-dark(rgb(255, 0, 0), rgb(0, 0, 0))"), ("#12345", None), ("rgb(1 2)", None),
)

# (query, serialised, matches a 1024 x 768 desktop screen)
MEDIA = (
    ("", "", True), ("screen", "screen", True), ("print", "print", False), ("not print", "not print", True), ("only screen and (color)", "only screen and (color)", True),
    ("(min-width: 600px)", "(min-width: 600px)", True), ("(max-width:600px)", "(max-width: 600px)", False), ("(400px <= width < 1024px)", "(400px <= width < 1024px)", False),
    ("(width >= 64em)", "(width >= 64em)", True), ("(orientation: landscape)", "(orientation: landscape)", True), ("(hover) and (pointer: fine)", "(hover) and (pointer: fine)", True),
    ("(hover) and (color) or (grid)", "not all", False), ("not (unknown)", "not (unknown)", False), ("(unknown) or (width)", "(unknown) or (width)", True),
    ("(aspect-ratio: 4/3)", "(aspect-ratio: 4 / 3)", True), ("(min-resolution: 96dpi)", "(min-resolution: 96dpi)", True), ("(color-gamut: p3)", "(color-gamut: p3)", False),
    ("(width: 1024.0005px)", "(width: 1024px)", True), ("(width: 1024.01px)", "(width: 1024.01px)", False), ("(min-width: 1024.0005px)", "(min-width: 1024px)", True), ("(width > 1023.9999px)", "(width > 1024px)", False),
    ("(resolution: 96.00001dpi)", "(resolution: 96dpi)", True), ("(height < 768px)", "(height < 768px)", False), ("(768px >= height > 0px)", "(768px >= height > 0px)", True), ("not all and (monochrome)", "not all and (monochrome)", True),
    ("(min-width: calc(10px * 2))", "(min-width: calc(20px))", True), ("screen and (max-width: 2000px), print and (orientation: portrait)", "screen and (max-width: 2000px), print and (orientation: portrait)", True),
    ("(prefers-color-scheme: dark), screen", "(prefers-color-scheme: dark), screen", True), ("all and (min-height:1px)", "(min-height: 1px)", True), ("(min-hover: hover)", "(min-hover: hover)", False),
)

# (condition, holds)
SUPPORTS = (("(display: flex)", True), ("(width: red)", False), ("not (-moz-appearance: none)", True), ("(unheard-of: 1) and (--x: 1)", True), ("selector(a > b)", True), ("selector(a:unknown)", False), ("(top: 1px) or (width: no)", True), ("(a: b) and (c: d) or (e: f)", False))

# (style of the parent, style, custom property, value or "")
VARIABLES = (
    ("", "--a: 1px", "--a", "1px"), ("--a: x", "", "--a", "x"), ("--a: x", "--a: initial", "--a", ""), ("--a: x", "--a: inherit", "--a", "x"),
    ("", "--a: var(--b); --b: 2", "--a", "2"), ("", "--a: var(--b); --b: var(--a)", "--a", ""), ("", "--a: var(--no, 3)", "--a", "3"), ("", "--a: var(--no)", "--a", ""),
    ("", "--a: 1; --b: var(--a)var(--a)", "--b", "1/**/1"), ("--b: 5", "--a: var(--c, var(--b))", "--a", "5"), ("", "--a: {x", "--a", "{x"), ("", "--a: x)", "--a", ""),
    ("", "--a: var(--b) x; --b: var(--c); --c: 1 2", "--a", "1 2 x"), ("", "--a: var(--a, 4)", "--a", ""), ("", "--a: var(--b, 1); --b: var(--a, 2)", "--b", ""), ("--a: 1", "--a: var(--a)", "--a", ""),
    ("", "--a: ( var(--b) ); --b: [x]", "--a", "( [x] )"), ("", "--a: var(--b,)", "--a", ""), ("", "--a: #var(--b); --b: f00", "--a", "#var(--b)"), ("", "--a: var(--b)0; --b: 1", "--a", "1/**/0"), ("--a: 1", "--a: unset", "--a", "1"), ("", "--a: x !y", "--a", ""),
    ("", "--a: var(--b, var(--c, 7))", "--a", "7"), ("", "--x: var(b)", "--x", ""), ("", "--x:  spaced  out  ", "--x", "spaced  out"), ("", "--x: 'var(--y)'; --y: 1", "--x", "'var(--y)'"),
    ("", "--A: 1; --a: 2", "--A", "1"), ("", "--a: 1 !important", "--a", "1"), ("", "--a: a; --b: b; --c: var(--a)var(--b)", "--c", "a/**/b"),
)

# (html, tag, [(x, y, w, h) of each such element]) in an 800 x 600 viewport, one device pixel a px, without fonts
LAYOUTS = (
    ("", "html", [(0.0, 0.0, 800.0, 8.0)]),
    ("<!doctype html><div style='width:100px;height:50px;margin:0 auto'></div>", "div", [(350.0, 8.0, 100.0, 50.0)]),
    ("<!doctype html><div style='height:10px;margin:20px 0'></div><div style='height:10px;margin:30px 0'></div>", "div", [(8.0, 20.0, 784.0, 10.0), (8.0, 60.0, 784.0, 10.0)]),
    ("<!doctype html><div style='padding:5px;border:2px solid'><p style='height:10px'></p></div>", "p", [(15.0, 31.0, 770.0, 10.0)]),
    ("<!doctype html><div style='width:50%;min-width:500px;box-sizing:border-box;padding:10px;height:40px'></div>", "div", [(8.0, 8.0, 500.0, 40.0)]),
    ("<!doctype html><div style='margin-bottom:-5px;height:20px'></div><p style='height:1px;margin:0'></p>", "p", [(8.0, 23.0, 784.0, 1.0)]),
    ("<!doctype html><div style='overflow:hidden'><p style='height:10px;margin:7px'></p></div>", "div", [(8.0, 8.0, 784.0, 24.0)]),
    ("<!doctype html><body style='margin:0;line-height:20px'><div>a<p style='height:5px;margin:0'></p>  </div>", "p", [(0.0, 20.0, 800.0, 5.0)]),
    ("<!doctype html><body style='margin:0;line-height:20px'><div>a<p style='height:5px;margin:0'></p>  </div>", "div", [(0.0, 0.0, 800.0, 25.0)]),
    ("<!doctype html><body style='margin:0'><div>  <p style='height:5px;margin:0'></p> <!-- --> </div>", "div", [(0.0, 0.0, 800.0, 5.0)]),
    ("<!doctype html><div style='margin:10px 0'><p style='margin:30px 0'></p></div><p style='height:1px;margin:0'></p>", "p", [(8.0, 30.0, 784.0, 0.0), (8.0, 30.0, 784.0, 1.0)]),
    ("<!doctype html><body style='margin:0'><div style='width:200px;margin-left:auto;height:1px'></div>", "div", [(600.0, 0.0, 200.0, 1.0)]),
    ("<!doctype html><body style='margin:0'><div style='width:900px;margin:0 auto;height:1px'></div>", "div", [(0.0, 0.0, 900.0, 1.0)]),
    ("<!doctype html><body style='margin:0'><div style='max-height:10px'><p style='height:40px;margin:0'></p></div><p style='height:1px;margin:0'></p>", "p", [(0.0, 0.0, 800.0, 40.0), (0.0, 10.0, 800.0, 1.0)]),
    ("<!doctype html><body style='margin:0'><div style='height:200px'><p style='height:50%;margin:0'></p></div>", "p", [(0.0, 0.0, 800.0, 100.0)]),
    ("<!doctype html><div style='display:none'><p></p></div><section style='height:3px'></section>", "section", [(8.0, 8.0, 784.0, 3.0)]),
)

# (family, weight, italic) of faces by number, and (family, weight, italic, number of the nearest)
FACES = (("A", 400, False), ("A", 700, False), ("A", 400, True), ("B", 300, False), ("B", 600, False), ("Times", 400, False))
NEAREST = (("A", 400, False, 0), ("a", 900, False, 1), ("A", 700, True, 2), ("B", 400, False, 3), ("B", 500, False, 3), ("B", 550, False, 4), ("B", 200, False, 3), ("serif", 400, False, 5))

# (page, host's tree): one page with a shadow root, named and default slots
SLOTTED = "<!doctype html><div><template shadowrootmode=open><style>:host{display:flex} b{opacity:0.5}</style><b><slot name=x>none</slot></b><slot></slot></template><i slot=x>1</i>t<u>2</u><s slot=y>3</s></div>"

# (page, name, public id, system id, quirks mode)
DOCTYPES = (
    ("<!DOCTYPE html>", "html", "", "", "no-quirks"), ("<!doctype HTML SYSTEM 'about:legacy-compat'>", "html", "", "about:legacy-compat", "no-quirks"), ("<!doctype>", "", "", "", "quirks"),
    ('<!doctype html public "-//W3C//DTD HTML 4.01 Transitional//EN">', "html", "-//W3C//DTD HTML 4.01 Transitional//EN", "", "quirks"),
    ('<!doctype html public "-//W3C//DTD HTML 4.01 Transitional//EN" "x">', "html", "-//W3C//DTD HTML 4.01 Transitional//EN", "x", "limited-quirks"),
    ('<!doctype html public "-//W3C//DTD XHTML 1.0 Frameset//EN" "x">', "html", "-//W3C//DTD XHTML 1.0 Frameset//EN", "x", "limited-quirks"), ("<!doctype html junk>", "html", "", "", "quirks"), ('<!doctype html public "a>', "html", "a", "", "quirks"), ("<!doctype xml>", "xml", "", "", "quirks"),
)

# (page, its comments and processing instructions joined by "|")
REMARKS = (
    ("<!-- a --><!--b--!><!-->c", " a |b|"), ("<!--->x<!---->", "|"), ("<!--a-", "a"), ("<!--a--!", "a"), ("<!x><?1 y></ z>", "x|?1 y| z"), ("<?go a b?><?go?><?XML c?>", "?go a b|?go |?XML c?"), ("<!--a<!--b-->", "a<!--b"), ("<![CDATA[x]]>", "[CDATA[x]]"),
    ("<svg><![CDATA[<b>]]>", ""), ("<?go a", ""),
)

# (css, as its component values are written again)
SERIALISED = (("a( 'b' ) [#c=1.0px]", 'a( "b" ) [#c=1.0px]'), ("x/**/y url( z ) 50%", 'xy url("z") 50%'), ("{a:b;c", "{a:b;c}"), ("\\31 a @m !", "\\31 a @m !"), ("+1e3x -.5", "+1e3x -.5"))

# (css, kinds of its rules joined by " ", names of at-rules)
RULES = (("a{} b{c:d}", "style style", ""), ("<!-- @import 'x'; p{} --> q{", "at style style", "import"), ("@media x { a{} } @y", "at at", "media y"), ("a;b{}", "style", ""), ("}", "", ""))

# (block, "name=value" with "!" if important, joined by "|")
BLOCKS = (("a: b; c:d!important; e; f: {;}; g : ", "a=b|c=d!|f={;}|g="), ("A:url(;);--x:  y  z ;", "A=url(;)|--x=y  z"), ("a:b ! IMPORTANT", "a=b!"), ("a:'x;y'", "a='x;y'"), (":b;c:d", "c=d"))

# (value, variables, what var() makes of it, or None)
SUBSTITUTIONS = (("var(--a) 2", "--a:1", "1 2"), ("calc(var(--b, 3px) + 1px)", "", "calc(3px + 1px)"), ("var(--c)", "", None), ("1/**/var(--a)", "--a:px", "1/**/px"), ("var(--a,)x", "", "x"), ("VAR( --a , b )", "--a:c", "c"))

# (selector in a shadow tree's sheet, whether it means a host <div class=a>)
HOSTS = ((":host", True), (":host(.a)", True), (":host(.b)", False), (":host(div.a)", True), (":host.a", False), ("div", False), (":host b", False), ("*", False))

# (page, tag, property, its computed value on the first such element) on a 1024 x 768 desktop screen
STYLES = (
    ("<style>@media (min-width: 1px) { p { top: 1px } }</style><p>", "p", "top", "1px"), ("<style>@media print { p { top: 1px } }</style><p>", "p", "top", "auto"),
    ("<style>@supports (display: flex) { p { top: 2px } } @supports (top: no) { p { top: 3px } }</style><p>", "p", "top", "2px"), ("<style>@layer x { p { top: 4px } }</style><p>", "p", "top", "4px"),
    ("<style>@media screen { @supports (top: 1px) { p { top: 5px } } }</style><p>", "p", "top", "5px"), ("<style>@import 'x'; @font-face { p { top: 1px } } p { top: 6px }</style><p>", "p", "top", "6px"),
    ("<style media=print>p { top: 1px }</style><style type=text/plain>p { top: 2px }</style><p>", "p", "top", "auto"), ("<style>p { top: 1px } @media (max-width: 1023px) { p { top: 2px } }</style><p>", "p", "top", "1px"),
    ("<style>p, .a, #b { top: 1px } p.a { top: 2px }</style><p class=a id=b>", "p", "top", "1px"), ("<style>p { top: 1px !important } #b { top: 2px }</style><p id=b style='top: 3px'>", "p", "top", "1px"),
    ("<svg><g hidden></g></svg>", "g", "display", "inline"), ("<b hidden>x</b>", "b", "display", "none"), ("<math><mi>x</mi></math>", "mi", "display", "block math"),
    ("<style>p { top: 3px; top: var(--no) }</style><p>", "p", "top", "auto"), ("<style>div { font-weight: 700 } p { font-weight: var(--no) }</style><div><p>", "p", "font-weight", "700"),
    ("<style>p { --w: 4px; margin: var(--w) var(--x, 5px) }</style><p>", "p", "margin-left", "5px"), ("<p style='--a: 1px solid; border: var(--a) red'>", "p", "border-top-width", "1px"), ("<p style='--a: banana; width: var(--a)'>", "p", "width", "auto"),
    ("<div style='--a: 7px'><p style='width: var(--a)'>", "p", "width", "7px"), ("<p style='width: 1px; width: banana'>", "p", "width", "1px"),
    ("<p style='font-size: larger'>", "p", "font-size", "19.2px"), ("<p style='font-size: x-small'>", "p", "font-size", "10px"), ("<pre style='font-size: large'>", "pre", "font-size", "16px"), ("<div style='font-size: 10px'><p style='font-size: smaller'>", "p", "font-size", "8.33333px"),
    ("<div style='font-size: 200%'><tt>x", "tt", "font-size", "26px"), ("<p style='font-size: 2rem'>", "p", "font-size", "32px"), ("<p style='font-size: calc(1em + 50%)'>", "p", "font-size", "24px"),
    ("<p style='font-size: 20px; line-height: 150%'>", "p", "line-height", "30px"), ("<p style='font-size: 20px; line-height: 1.5'>", "p", "line-height", "30px"), ("<div style='line-height: 1.5'><p style='font-size: 10px'>", "p", "line-height", "15px"),
    ("<div style='font-size: 20px; line-height: 150%'><p style='font-size: 10px'>", "p", "line-height", "30px"), ("<p style='font-size: 20px; line-height: calc(50% + 3px)'>", "p", "line-height", "13px"), ("<p>", "p", "line-height", "normal"),
    ("<p style='width: calc(50% + 10px - 1em)'>", "p", "width", "calc(50% - 6px)"), ("<p style='margin-left: calc(2 * (1em + 1px))'>", "p", "margin-left", "34px"), ("<p style='width: calc(10% - 3px)'>", "p", "width", "calc(10% - 3px)"), ("<p style='width: 10vw; height: 1vh'>", "p", "width", "102.4px"),
    ("<p style='margin-top: 1in'>", "p", "margin-top", "96px"), ("<p style='border: 2px none'>", "p", "border-top-width", "0px"), ("<p style='border: 0.5px solid'>", "p", "border-top-width", "1px"), ("<p style='border: 2.9px solid'>", "p", "border-top-width", "2px"),
    ("<p style='overflow-x: clip; overflow-y: scroll'>", "p", "overflow-x", "hidden"), ("<i style='position: absolute; float: left'>", "i", "float", "none"), ("<i style='position: absolute'>", "i", "display", "block"), ("<div style='display: flex'><i>", "i", "display", "block"),
    ("<div style='display: grid'><i style='display: inline-table'>", "i", "display", "table"), ("<b><b><b>x", "b", "font-weight", "700"), ("<style>i { font-weight: lighter }</style><b><i>x", "i", "font-weight", "400"), ("<p style='opacity: 7'>", "p", "opacity", "1"),
)

# (css, what parsing one rule of it gives: its kind, or why there is none)
ONE_RULE = (("a{}", "style"), (" @m x; ", "at"), ("", "empty"), (" /**/ ", "empty"), ("a{} b{}", "extra input"), ("a", "invalid"), ("@m{} x", "extra input"), ("a{", "style"))

# (css, what parsing one declaration of it gives: "name=value" with "!" if important, or why there is none)
ONE_DECLARATION = (("a: b", "a=b"), ("", "empty"), (" a : b c !important ", "a=b c!"), ("a b", "invalid"), ("1: b", "invalid"), (":", "invalid"))

# (block, what is in it: declarations as "name=value", at-rules as "@name", nested rules as "{}", joined by "|")
CONTENTS = (("a: b; c: d", "a=b|c=d"), ("a: b; & x { c: d } e: f", "a=b|{}|e=f"), ("@m x; a: b; @n { c: d }", "@m|a=b|@n"), ("a:hover { b: c } d: e", "{}|d=e"), ("--x: { y: z }; a: b", "--x={ y: z }|a=b"), ("junk; a: b", "a=b"), ("a: {b}", "a={b}"), ("", ""))

# (unit, px) by the definitions of absolute units
UNITS = (("px", 1.0), ("in", 96.0), ("cm", 96.0 / 2.54), ("mm", 96.0 / 25.4), ("q", 96.0 / 101.6), ("pt", 96.0 / 72.0), ("pc", 16.0))


def font_file(kern: bool = False, positions: bool = False, family: str = "Face", bold: bool = True) -> bytes:
    """A font with glyphs 1 and 2 for a and b, table by table; a before b is 50 units nearer by `kern` and 70 by `positions`."""
    u = lambda *x: struct.pack(f">{len(x)}H", *(v & 0xFFFF for v in x))
    name = family.encode("utf-16-be")
    t = {
        b"head": bytes(18) + u(1000) + bytes(24) + u(int(bold)) + bytes(8),
        b"hhea": bytes(4) + u(800, -200, 50) + bytes(24) + u(2),
        b"maxp": bytes(4) + u(3),
        b"hmtx": u(100, 0, 600, 0),
        b"cmap": u(0, 1, 3, 1, 0, 12) + u(4, 32, 0, 4, 0, 0, 0, 98, 0xFFFF, 0, 97, 0xFFFF, 1 - 97, 1, 0, 0),
        b"name": u(0, 1, 18, 3, 1, 0x409, 1, len(name), 0) + name,
    }
    if kern:
        t[b"kern"] = u(0, 1, 0, 20, 1, 1, 0, 0, 0, 1, 2, -50)
    if positions:  # one script, one feature, one lookup of pairs
        script = u(1) + b"DFLT" + u(8, 4, 0, 0, 0xFFFF, 1, 0)
        feature = u(1) + b"kern" + u(8, 0, 1, 0)
        lookup = u(1, 4, 2, 0, 1, 8) + u(1, 18, 4, 0, 1, 12, 1, 2, -70) + u(1, 1, 1)
        t[b"GPOS"] = u(1, 0, 10, 10 + len(script), 10 + len(script) + len(feature)) + script + feature + lookup
    head, body = b"\0\1\0\0" + u(len(t), 0, 0, 0), b""
    for tag, raw in t.items():
        head += tag + struct.pack(">III", 0, 12 + 16 * len(t) + len(body), len(raw))
        body += raw
    return head + body


# (font_file's arguments, family, weight, units per em, glyphs, advances of "ab")
FONTS = (({}, "Face", 700, 1000, 3, "600 600"), ({"bold": False, "family": "Other"}, "Other", 400, 1000, 3, "600 600"), ({"kern": True}, "Face", 700, 1000, 3, "550 600"), ({"positions": True}, "Face", 700, 1000, 3, "530 600"))
