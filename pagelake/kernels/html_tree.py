"""DOM trees from HTML pages, by the tree construction rules of the HTML Standard."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .html_lexer import Lexer, ascii_lower

HTML, SVG, MATH = "html", "svg", "mathml"
PREFIX = {HTML: "", SVG: "svg ", MATH: "math "}


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Fixed values of the HTML Standard.
SPECIAL = _set(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing "
    "main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section source style summary table tbody td "
    "template textarea tfoot th thead title tr track ul wbr xmp"
)
MATH_SPECIAL, SVG_SPECIAL = _set("mi mo mn ms mtext annotation-xml"), _set("foreignObject desc title")
SCOPE = _set("applet caption html table td th marquee object template")
IMPLIED = _set("dd dt li optgroup option p rb rp rt rtc")
THOROUGH = IMPLIED | _set("caption colgroup tbody td tfoot th thead tr")
HEADINGS = _set("h1 h2 h3 h4 h5 h6")
HEAD_START = _set("base basefont bgsound link meta noframes script style template title")
BLOCKS = _set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul")
BLOCK_ENDS = (BLOCKS - {"p"}) | _set("button listing pre")
FORMATTING = _set("a b big code em font i nobr s small strike strong tt u")
TABLE_PARTS = _set("caption col colgroup tbody td tfoot th thead tr")
TABLE_HOSTS = _set("table tbody tfoot thead tr")
BREAKOUT = _set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var")
SVG_TAGS = {
    x.lower(): x
    for x in (
        "altGlyph altGlyphDef altGlyphItem animateColor animateMotion animateTransform clipPath feBlend feColorMatrix feComponentTransfer feComposite "
        "feConvolveMatrix feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage "
        "feMerge feMergeNode feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence foreignObject glyphRef linearGradient "
        "radialGradient textPath"
    ).split()
}
SVG_ATTRS = {
    x.lower(): x
    for x in (
        "attributeName attributeType baseFrequency baseProfile calcMode clipPathUnits diffuseConstant edgeMode filterUnits glyphRef gradientTransform "
        "gradientUnits kernelMatrix kernelUnitLength keyPoints keySplines keyTimes lengthAdjust limitingConeAngle markerHeight markerUnits markerWidth "
        "maskContentUnits maskUnits numOctaves pathLength patternContentUnits patternTransform patternUnits pointsAtX pointsAtY pointsAtZ preserveAlpha "
        "preserveAspectRatio primitiveUnits refX refY repeatCount repeatDur requiredExtensions requiredFeatures specularConstant specularExponent spreadMethod "
        "startOffset stdDeviation stitchTiles surfaceScale systemLanguage tableValues targetX targetY textLength viewBox viewTarget xChannelSelector "
        "yChannelSelector zoomAndPan"
    ).split()
}
FOREIGN_ATTRS = {f"xlink:{x}": ("xlink", x) for x in "actuate arcrole href role show title type".split()} | {"xml:lang": ("xml", "lang"), "xml:space": ("xml", "space"), "xmlns": ("xmlns", "xmlns"), "xmlns:xlink": ("xmlns", "xlink")}
SHADOW_HOSTS = _set("article aside blockquote body div footer h1 h2 h3 h4 h5 h6 header main nav p section span")
RESERVED_CUSTOM = _set("annotation-xml color-profile font-face font-face-src font-face-uri font-face-format font-face-name missing-glyph")
CUSTOM_NAME = re.compile(
    r"[a-z][-.0-9_a-z\u00b7\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u037d\u037f-\u1fff\u200c-\u200d\u203f-\u2040\u2070-\u218f\u2c00-\u2fef\u3001-\ud7ff\uf900-\ufdcf\ufdf0-\ufffd\U00010000-\U000effff]*"
)
QUIRKY_PUBLIC = ("-//w3o//dtd w3 html strict 3.0//en//", "-/w3c/dtd html 4.0 transitional/en", "html")
QUIRKY_SYSTEM = "http://www.ibm.com/data/dtd/v11/ibmxhtml1-transitional.dtd"
QUIRKY_PREFIXES = (
    "+//silmaril//dtd html pro v0r11 19970101//",
    "-//as//dtd html 3.0 aswedit + extensions//",
    "-//advasoft ltd//dtd html 3.0 aswedit + extensions//",
    "-//ietf//dtd html 2.0 level 1//",
    "-//ietf//dtd html 2.0 level 2//",
    "-//ietf//dtd html 2.0 strict level 1//",
    "-//ietf//dtd html 2.0 strict level 2//",
    "-//ietf//dtd html 2.0 strict//",
    "-//ietf//dtd html 2.0//",
    "-//ietf//dtd html 2.1e//",
    "-//ietf//dtd html 3.0//",
    "-//ietf//dtd html 3.2 final//",
    "-//ietf//dtd html 3.2//",
    "-//ietf//dtd html 3//",
    "-//ietf//dtd html level 0//",
    "-//ietf//dtd html level 1//",
    "-//ietf//dtd html level 2//",
    "-//ietf//dtd html level 3//",
    "-//ietf//dtd html strict level 0//",
    "-//ietf//dtd html strict level 1//",
    "-//ietf//dtd html strict level 2//",
    "-//ietf//dtd html strict level 3//",
    "-//ietf//dtd html strict//",
    "-//ietf//dtd html//",
    "-//metrius//dtd metrius presentational//",
    "-//microsoft//dtd internet explorer 2.0 html strict//",
    "-//microsoft//dtd internet explorer 2.0 html//",
    "-//microsoft//dtd internet explorer 2.0 tables//",
    "-//microsoft//dtd internet explorer 3.0 html strict//",
    "-//microsoft//dtd internet explorer 3.0 html//",
    "-//microsoft//dtd internet explorer 3.0 tables//",
    "-//netscape comm. corp.//dtd html//",
    "-//netscape comm. corp.//dtd strict html//",
    "-//o'reilly and associates//dtd html 2.0//",
    "-//o'reilly and associates//dtd html extended 1.0//",
    "-//o'reilly and associates//dtd html extended relaxed 1.0//",
    "-//sq//dtd html 2.0 hotmetal + extensions//",
    "-//softquad software//dtd hotmetal pro 6.0::19990601::extensions to html 4.0//",
    "-//softquad//dtd hotmetal pro 4.0::19971010::extensions to html 4.0//",
    "-//spyglass//dtd html 2.0 extended//",
    "-//sun microsystems corp.//dtd hotjava html//",
    "-//sun microsystems corp.//dtd hotjava strict html//",
    "-//w3c//dtd html 3 1995-03-24//",
    "-//w3c//dtd html 3.2 draft//",
    "-//w3c//dtd html 3.2 final//",
    "-//w3c//dtd html 3.2//",
    "-//w3c//dtd html 3.2s draft//",
    "-//w3c//dtd html 4.0 frameset//",
    "-//w3c//dtd html 4.0 transitional//",
    "-//w3c//dtd html experimental 19960712//",
    "-//w3c//dtd html experimental 970421//",
    "-//w3c//dtd w3 html//",
    "-//w3o//dtd w3 html 3.0//",
    "-//webtechs//dtd mozilla html 2.0//",
    "-//webtechs//dtd mozilla html//",
)

_LEAD = re.compile(r"[\t\n\f\r ]*")
_NON_SPACE = re.compile(r"[^\t\n\f\r ]")


class Node:
    __slots__ = ("attrs", "content", "data", "extra", "host", "kids", "kind", "name", "ns", "parent", "shadow")

    def __init__(self, kind: str, name: str = "", ns: str = "", attrs=None, data: str = ""):
        self.kind, self.name, self.ns, self.attrs, self.data = kind, name, ns, attrs, data
        self.parent: Node | None = None
        self.kids: list[Node] = []
        self.content: Node | None = None  # of a template
        self.shadow: Node | None = None
        self.host: Node | None = None  # of a shadow root
        self.extra = None

    def get(self, name: str) -> str | None:
        for ns, n, v in self.attrs or ():
            if n == name and not ns:
                return v
        return None

    def add(self, kid: Node, before: Node | None = None) -> None:
        if before is None:
            self.kids.append(kid)
        else:
            self.kids.insert(self.place(before), kid)
        kid.parent = self

    def place(self, kid: Node) -> int:
        for i in range(len(self.kids) - 1, -1, -1):
            if self.kids[i] is kid:
                return i
        raise ValueError

    def leave(self) -> None:
        if self.parent is not None:
            del self.parent.kids[self.parent.place(self)]
            self.parent = None


@dataclass
class Options:
    scripting: bool = False
    declarative_shadow_roots: bool = False


def quirks_of(name: str, public: str | None, system: str | None, force: bool) -> str:
    p, s = (None if x is None else ascii_lower(x) for x in (public, system))
    starts = lambda *x: p is not None and p.startswith(x)
    html401 = ("-//w3c//dtd html 4.01 frameset//", "-//w3c//dtd html 4.01 transitional//")
    if force or name != "html" or p in QUIRKY_PUBLIC or s == QUIRKY_SYSTEM or starts(*QUIRKY_PREFIXES) or (s is None and starts(*html401)):
        return "quirks"
    if starts("-//w3c//dtd xhtml 1.0 frameset//", "-//w3c//dtd xhtml 1.0 transitional//") or (s is not None and starts(*html401)):
        return "limited-quirks"
    return "no-quirks"


class _Marker:
    pass


MARKER = _Marker()


class TreeBuilder:
    def __init__(self, source: str, options: Options | None = None, context: tuple[str, str] | None = None):
        self.o = options or Options()
        self.doc = Node("document")
        self.quirks = "no-quirks"
        self.open: list[Node] = []
        self.active: list = []  # (node, name, attrs) of open formatting, and markers
        self.template_modes: list = []
        self.head: Node | None = None
        self.form: Node | None = None
        self.frameset_ok = True
        self.fostering = False
        self.drop_lf = False
        self.pending_text: list[str] = []
        self.selectedcontent = False
        self.mode = self.initial
        self.original = None
        self.context: Node | None = None
        self.lexer = Lexer(source, cdata=self._foreign_now)
        if context:
            self._start_fragment(*context)

    def _start_fragment(self, ns: str, name: str) -> None:
        self.context = self._element(name, [], ns)
        if ns == HTML:
            raw = {"title": "rcdata", "textarea": "rcdata", "script": "script", "plaintext": "plaintext"} | dict.fromkeys(("style", "xmp", "iframe", "noembed", "noframes"), "rawtext")
            if self.o.scripting:
                raw["noscript"] = "rawtext"
            self.lexer.state = raw.get(name, "data")
        root = self._element("html", [], HTML)
        self.doc.add(root)
        self.open.append(root)
        if self._is(self.context, "template"):
            self.template_modes.append(self.in_template)
        self.reset_mode()
        if self._is(self.context, "form"):
            self.form = self.context

    # running

    def run(self) -> TreeBuilder:
        while True:
            t = self.lexer.next()
            if self.drop_lf:
                self.drop_lf = False
                if t[0] == "text" and t[1][0] == "\n":
                    if len(t[1]) == 1:
                        continue
                    t = ("text", t[1][1:])
            again = True
            while again:
                again = self.foreign(t) if self._use_foreign(t) else self.mode(t)
            if t[0] == "eof":
                break
        if self.selectedcontent:
            self._fill_selectedcontent()
        return self

    def _adjusted(self) -> Node | None:
        if len(self.open) == 1 and self.context is not None:
            return self.context
        return self.open[-1] if self.open else None

    def _foreign_now(self) -> bool:
        n = self._adjusted()
        return n is not None and n.ns != HTML

    def _use_foreign(self, t: tuple) -> bool:
        n = self._adjusted()
        if n is None or n.ns == HTML or t[0] == "eof":
            return False
        if self._math_text(n) and ((t[0] == "start" and t[1] not in ("mglyph", "malignmark")) or t[0] == "text"):
            return False
        if n.ns == MATH and n.name == "annotation-xml" and t[0] == "start" and t[1] == "svg":
            return False
        return not (self._html_point(n) and t[0] in ("start", "text"))

    @staticmethod
    def _math_text(n: Node) -> bool:
        return n.ns == MATH and n.name in ("mi", "mo", "mn", "ms", "mtext")

    @staticmethod
    def _html_point(n: Node) -> bool:
        if n.ns == SVG:
            return n.name in SVG_SPECIAL
        return n.ns == MATH and n.name == "annotation-xml" and ascii_lower(n.get("encoding") or "") in ("text/html", "application/xhtml+xml")

    # the stack

    @staticmethod
    def _is(n: Node | None, *names: str) -> bool:
        return n is not None and n.ns == HTML and n.name in names

    @staticmethod
    def _special(n: Node) -> bool:
        return n.name in (SPECIAL if n.ns == HTML else MATH_SPECIAL if n.ns == MATH else SVG_SPECIAL)

    def in_scope(self, names, more: tuple[str, ...] = ()) -> bool:
        names = (names,) if isinstance(names, str) else names
        for n in reversed(self.open):
            if n.ns == HTML:
                if n.name in names:
                    return True
                if n.name in SCOPE or n.name in more:
                    return False
            elif n.name in (MATH_SPECIAL if n.ns == MATH else SVG_SPECIAL):
                return False
        return False

    def in_table_scope(self, *names: str) -> bool:
        for n in reversed(self.open):
            if n.ns == HTML:
                if n.name in names:
                    return True
                if n.name in ("html", "table", "template"):
                    return False
        return False

    def node_in_scope(self, target: Node) -> bool:
        for n in reversed(self.open):
            if n is target:
                return True
            if n.name in (SCOPE if n.ns == HTML else MATH_SPECIAL if n.ns == MATH else SVG_SPECIAL):
                return False
        return False

    def pop_until(self, *names: str) -> None:
        while self.open:
            if self._is(self.open.pop(), *names):
                return

    def implied(self, but: str = "", which: frozenset = IMPLIED) -> None:
        while self.open and self.open[-1].ns == HTML and self.open[-1].name in which and self.open[-1].name != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.in_scope("p", ("button",)):
            self.implied("p")
            self.pop_until("p")

    def has_template(self) -> bool:
        return any(self._is(n, "template") for n in self.open)

    def _remove_open(self, node: Node) -> None:
        self.open = [n for n in self.open if n is not node]

    # inserting

    def _element(self, name: str, attrs: list, ns: str) -> Node:
        n = Node("element", name, ns, [a if len(a) == 3 else ("", *a) for a in attrs])
        if ns == HTML and name == "template":
            n.content = Node("fragment")
        if name == "selectedcontent":
            self.selectedcontent = True
        return n

    def place(self, target: Node | None = None) -> tuple[Node, Node | None]:
        target = target or self.open[-1]
        if self.fostering and self._is(target, *TABLE_HOSTS):
            for i in range(len(self.open) - 1, -1, -1):
                n = self.open[i]
                if self._is(n, "template"):
                    return n.content, None
                if self._is(n, "table"):
                    return (n.parent, n) if n.parent is not None else (self.open[i - 1], None)
            return self.open[0], None
        return (target.content, None) if target.content is not None else (target, None)

    def insert(self, name: str, attrs: list, ns: str = HTML) -> Node:
        n = self._element(name, attrs, ns)
        parent, before = self.place()
        parent.add(n, before)
        self.open.append(n)
        return n

    def insert_tag(self, t: tuple) -> Node:
        return self.insert(t[1], t[2])

    def insert_void(self, t: tuple) -> None:
        self.insert(t[1], t[2])
        self.open.pop()

    def insert_text(self, text: str) -> None:
        parent, before = self.place()
        if parent.kind == "document" or not text:
            return
        at = len(parent.kids) if before is None else parent.place(before)
        last = parent.kids[at - 1] if at else None
        if last is not None and last.kind == "text":
            last.data += text
            return
        n = Node("text", data=text)
        parent.kids.insert(at, n)
        n.parent = parent

    def comment(self, t: tuple, parent: Node | None = None) -> None:
        n = Node("comment", data=t[1]) if t[0] == "comment" else Node("pi", t[1], data=t[2])
        if parent is not None:
            parent.add(n)
        else:
            p, before = self.place()
            p.add(n, before)

    @staticmethod
    def merge(n: Node, attrs: list) -> None:
        have = {a[1] for a in n.attrs if not a[0]}
        n.attrs += [("", *a) for a in attrs if a[0] not in have]

    def raw_text(self, t: tuple, state: str) -> None:
        self.insert_tag(t)
        self.lexer.state = state
        self.original, self.mode = self.mode, self.text

    # formatting

    def push_active(self, node: Node, t: tuple) -> None:
        key = sorted(t[2])
        same = []
        for i in range(len(self.active) - 1, -1, -1):
            e = self.active[i]
            if e is MARKER:
                break
            if e[1] == t[1] and sorted(e[2]) == key:
                same.append(i)
        if len(same) >= 3:
            del self.active[same[-1]]
        self.active.append((node, t[1], t[2]))

    def reconstruct(self) -> None:
        if not self.active:
            return
        i = len(self.active)
        while i and self.active[i - 1] is not MARKER and not any(self.active[i - 1][0] is n for n in self.open):
            i -= 1
        for k in range(i, len(self.active)):
            _, name, attrs = self.active[k]
            self.active[k] = (self.insert(name, attrs), name, attrs)

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not MARKER:
            pass

    def active_index(self, node: Node) -> int:
        for i, e in enumerate(self.active):
            if e is not MARKER and e[0] is node:
                return i
        return -1

    def open_index(self, node: Node) -> int:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] is node:
                return i
        return -1

    def adopt(self, subject: str) -> None:
        """The adoption agency: an end tag of formatting that is misnested."""
        top = self.open[-1]
        if self._is(top, subject) and self.active_index(top) < 0:
            self.open.pop()
            return
        for _ in range(8):
            entry = None
            for e in reversed(self.active):
                if e is MARKER:
                    break
                if e[1] == subject:
                    entry = e
                    break
            if entry is None:
                self.other_end(subject)
                return
            node = entry[0]
            at = self.open_index(node)
            if at < 0:
                del self.active[self.active_index(node)]
                return
            if not self.node_in_scope(node):
                return
            block_at = next((i for i in range(at + 1, len(self.open)) if self._special(self.open[i])), -1)
            if block_at < 0:
                del self.open[at:]
                del self.active[self.active_index(node)]
                return
            block, ancestor = self.open[block_at], self.open[at - 1]
            mark = self.active_index(node)
            last, i, count = block, block_at, 0
            while True:
                i -= 1
                count += 1
                n = self.open[i]
                if n is node:
                    break
                k = self.active_index(n)
                if count > 3 and k >= 0:
                    del self.active[k]
                    if k < mark:
                        mark -= 1
                    k = -1
                if k < 0:
                    del self.open[i]
                    continue
                _, name, attrs = self.active[k]
                fresh = self._element(name, attrs, HTML)
                self.active[k] = (fresh, name, attrs)
                self.open[i] = fresh
                if last is block:
                    mark = k + 1
                last.leave()
                fresh.add(last)
                last = fresh
            last.leave()
            parent, before = self.place(ancestor)
            parent.add(last, before)
            fresh = self._element(entry[1], entry[2], HTML)
            for kid in list(block.kids):
                kid.parent = None
                fresh.add(kid)
            block.kids = []
            block.add(fresh)
            k = self.active_index(node)
            del self.active[k]
            if k < mark:
                mark -= 1
            self.active.insert(mark, (fresh, entry[1], entry[2]))
            self._remove_open(node)
            self.open.insert(self.open_index(block) + 1, fresh)

    def other_end(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            n = self.open[i]
            if self._is(n, name):
                self.implied(name)
                del self.open[i:]
                return
            if self._special(n):
                return

    # modes: each takes a token and says whether it is to be gone through again

    def initial(self, t: tuple) -> bool:
        k = t[0]
        if k == "text":
            if not _NON_SPACE.search(t[1]):
                return False
        elif k in ("comment", "pi"):
            self.comment(t, self.doc)
            return False
        elif k == "doctype":
            self.quirks = quirks_of(*t[1:])
            n = Node("doctype", t[1])
            n.extra = (t[2] or "", t[3] or "")
            self.doc.add(n)
            self.mode = self.before_html
            return False
        self.quirks = "quirks"
        self.mode = self.before_html
        return True

    def before_html(self, t: tuple) -> bool:
        k = t[0]
        if k == "doctype":
            return False
        if k in ("comment", "pi"):
            self.comment(t, self.doc)
            return False
        if k == "text" and not _NON_SPACE.search(t[1]):
            return False
        if k == "end" and t[1] not in ("head", "body", "html", "br"):
            return False
        attrs = t[2] if k == "start" and t[1] == "html" else []
        n = self._element("html", attrs, HTML)
        self.doc.add(n)
        self.open.append(n)
        self.mode = self.before_head
        return not (k == "start" and t[1] == "html")

    def before_head(self, t: tuple) -> bool:
        k = t[0]
        if (k == "text" and not _NON_SPACE.search(t[1])) or k == "doctype":
            return False
        if k in ("comment", "pi"):
            self.comment(t)
            return False
        if k == "start" and t[1] == "html":
            return self.in_body(t)
        if k == "start" and t[1] == "head":
            self.head = self.insert_tag(t)
            self.mode = self.in_head
            return False
        if k == "end" and t[1] not in ("head", "body", "html", "br"):
            return False
        self.head = self.insert("head", [])
        self.mode = self.in_head
        if k == "text":
            return self._without_lead(t)
        return True

    def _without_lead(self, t: tuple) -> bool:
        """The text behind leading white space goes on to the new mode."""
        rest = t[1][_LEAD.match(t[1]).end() :]
        again = True
        while again:
            again = self.mode(("text", rest))
        return False

    def in_head(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "text":
            lead = _LEAD.match(name).end()
            if lead:
                self.insert_text(name[:lead])
            if lead == len(name):
                return False
            self.open.pop()
            self.mode = self.after_head
            return self._without_lead(t)
        if k in ("comment", "pi"):
            self.comment(t)
            return False
        if k == "doctype":
            return False
        if k == "start":
            if name == "html":
                return self.in_body(t)
            if name in ("base", "basefont", "bgsound", "link", "meta"):
                self.insert_void(t)
                return False
            if name == "title":
                self.raw_text(t, "rcdata")
                return False
            if name in ("noframes", "style") or (name == "noscript" and self.o.scripting):
                self.raw_text(t, "rawtext")
                return False
            if name == "noscript":
                self.insert_tag(t)
                self.mode = self.in_head_noscript
                return False
            if name == "script":
                self.raw_text(t, "script")
                return False
            if name == "template":
                self.active.append(MARKER)
                self.frameset_ok = False
                self.mode = self.in_template
                self.template_modes.append(self.in_template)
                self.insert_template(t)
                return False
            if name == "head":
                return False
        elif k == "end":
            if name == "head":
                self.open.pop()
                self.mode = self.after_head
                return False
            if name == "template":
                if self.has_template():
                    self.close_template()
                return False
            if name not in ("body", "html", "br"):
                return False
        self.open.pop()
        self.mode = self.after_head
        return True

    def insert_template(self, t: tuple) -> None:
        mode = next((ascii_lower(v) for n, v in t[2] if n == "shadowrootmode"), "")
        host = self._adjusted()
        if not self.o.declarative_shadow_roots or mode not in ("open", "closed") or host is self.open[0]:
            self.insert_tag(t)
            return
        parent, before = self.place()
        template = self._element(t[1], t[2], HTML)
        self.open.append(template)
        custom = CUSTOM_NAME.fullmatch(host.name) and "-" in host.name and host.name not in RESERVED_CUSTOM
        if host.ns != HTML or host.shadow is not None or not (host.name in SHADOW_HOSTS or custom):
            parent.add(template, before)
            return
        root = Node("shadow")
        have = {n for n, _ in t[2]}
        root.extra = (mode, *(f"shadowroot{x}" in have for x in ("clonable", "serializable", "delegatesfocus")))
        root.host, host.shadow, template.content = host, root, root

    def close_template(self) -> None:
        self.implied("", THOROUGH)
        self.pop_until("template")
        self.clear_active()
        self.template_modes.pop()
        self.reset_mode()

    def in_head_noscript(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "doctype":
            return False
        if k == "start" and name == "html":
            return self.in_body(t)
        if k == "end" and name == "noscript":
            self.open.pop()
            self.mode = self.in_head
            return False
        if k == "text":
            lead = _LEAD.match(name).end()
            if lead:
                self.insert_text(name[:lead])
            if lead == len(name):
                return False
            self.open.pop()
            self.mode = self.in_head
            return self._without_lead(t)
        if k in ("comment", "pi") or (k == "start" and name in ("basefont", "bgsound", "link", "meta", "noframes", "style")):
            return self.in_head(t)
        if (k == "start" and name in ("head", "noscript")) or (k == "end" and name != "br"):
            return False
        self.open.pop()
        self.mode = self.in_head
        return True

    def after_head(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "text":
            lead = _LEAD.match(name).end()
            if lead:
                self.insert_text(name[:lead])
            if lead == len(name):
                return False
            self.insert("body", [])
            self.mode = self.in_body
            return self._without_lead(t)
        if k in ("comment", "pi"):
            self.comment(t)
            return False
        if k == "doctype":
            return False
        if k == "start":
            if name == "html":
                return self.in_body(t)
            if name == "body":
                self.insert_tag(t)
                self.frameset_ok = False
                self.mode = self.in_body
                return False
            if name == "frameset":
                self.insert_tag(t)
                self.mode = self.in_frameset
                return False
            if name in HEAD_START:
                self.open.append(self.head)
                self.in_head(t)
                self._remove_open(self.head)
                return False
            if name == "head":
                return False
        elif k == "end":
            if name == "template":
                return self.in_head(t)
            if name not in ("body", "html", "br"):
                return False
        self.insert("body", [])
        self.mode = self.in_body
        return True

    def in_body(self, t: tuple) -> bool:
        k = t[0]
        if k == "text":
            text = t[1].replace("\0", "") if "\0" in t[1] else t[1]
            if text:
                self.reconstruct()
                self.insert_text(text)
                if self.frameset_ok and _NON_SPACE.search(text):
                    self.frameset_ok = False
            return False
        if k == "start":
            return self.body_start(t)
        if k == "end":
            return self.body_end(t)
        if k in ("comment", "pi"):
            self.comment(t)
            return False
        if k == "eof" and self.template_modes:
            return self.in_template(t)
        return False

    def _special_context(self) -> bool:
        return self.has_template() or self._is(self.context, "template")

    def body_start(self, t: tuple) -> bool:
        name = t[1]
        if name in BLOCKS:
            self.close_p()
            self.insert_tag(t)
        elif name in FORMATTING:
            if name == "a":
                for e in reversed(self.active):
                    if e is MARKER:
                        break
                    if e[1] == "a":
                        self.adopt("a")
                        i = self.active_index(e[0])
                        if i >= 0:
                            del self.active[i]
                        self._remove_open(e[0])
                        break
            self.reconstruct()
            if name == "nobr" and self.in_scope("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.push_active(self.insert_tag(t), t)
        elif name in HEADINGS:
            self.close_p()
            if self._is(self.open[-1], *HEADINGS):
                self.open.pop()
            self.insert_tag(t)
        elif name in ("li", "dd", "dt"):
            self.frameset_ok = False
            closes = ("li",) if name == "li" else ("dd", "dt")
            for n in reversed(self.open):
                if self._is(n, *closes):
                    self.implied(n.name)
                    self.pop_until(n.name)
                    break
                if self._special(n) and not self._is(n, "address", "div", "p"):
                    break
            self.close_p()
            self.insert_tag(t)
        elif name in ("area", "br", "embed", "img", "keygen", "wbr"):
            self.reconstruct()
            self.insert_void(t)
            self.frameset_ok = False
        elif name == "html":
            if not self.has_template():
                self.merge(self.open[0], t[2])
        elif name in HEAD_START:
            return self.in_head(t)
        elif name == "body":
            if len(self.open) > 1 and self._is(self.open[1], "body") and not self.has_template():
                self.frameset_ok = False
                self.merge(self.open[1], t[2])
        elif name == "frameset":
            if len(self.open) > 1 and self._is(self.open[1], "body") and self.frameset_ok:
                self.open[1].leave()
                del self.open[1:]
                self.insert_tag(t)
                self.mode = self.in_frameset
        elif name in ("pre", "listing"):
            self.close_p()
            self.insert_tag(t)
            self.drop_lf = True
            self.frameset_ok = False
        elif name == "form":
            free = self._special_context()
            if self.form is not None and not free:
                return False
            self.close_p()
            n = self.insert_tag(t)
            if not free:
                self.form = n
        elif name == "plaintext":
            self.close_p()
            self.insert_tag(t)
            self.lexer.state = "plaintext"
        elif name == "button":
            if self.in_scope("button"):
                self.implied()
                self.pop_until("button")
            self.reconstruct()
            self.insert_tag(t)
            self.frameset_ok = False
        elif name in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert_tag(t)
            self.active.append(MARKER)
            self.frameset_ok = False
        elif name == "input":
            if self.in_scope("select"):
                self.pop_until("select")
            elif self._is(self.context, "select"):
                return False
            self.reconstruct()
            self.insert_void(t)
            if ascii_lower(next((v for n, v in t[2] if n == "type"), "")) != "hidden":
                self.frameset_ok = False
        elif name in ("param", "source", "track"):
            self.insert_void(t)
        elif name == "hr":
            self.close_p()
            if self.in_scope("select"):
                self.implied()
            self.insert_void(t)
            self.frameset_ok = False
        elif name == "image":
            return self.body_start(("start", "img", *t[2:]))
        elif name == "textarea":
            self.raw_text(t, "rcdata")
            self.drop_lf = True
            self.frameset_ok = False
        elif name == "xmp":
            self.close_p()
            self.reconstruct()
            self.frameset_ok = False
            self.raw_text(t, "rawtext")
        elif name == "iframe":
            self.frameset_ok = False
            self.raw_text(t, "rawtext")
        elif name == "noembed" or (name == "noscript" and self.o.scripting):
            self.raw_text(t, "rawtext")
        elif name == "select":
            if self.in_scope("select"):
                self.pop_until("select")
            elif not self._is(self.context, "select"):
                self.reconstruct()
                self.insert_tag(t)
                self.frameset_ok = False
        elif name in ("option", "optgroup"):
            if self.in_scope("select"):
                self.implied("optgroup" if name == "option" else "")
            elif self._is(self.open[-1], "option"):
                self.open.pop()
            self.reconstruct()
            self.insert_tag(t)
        elif name in ("rb", "rtc", "rp", "rt"):
            if self.in_scope("ruby"):
                self.implied("rtc" if name in ("rp", "rt") else "")
            self.insert_tag(t)
        elif name in ("math", "svg"):
            self.reconstruct()
            self.insert_foreign(t, MATH if name == "math" else SVG)
        elif name == "table":
            if self.quirks != "quirks":
                self.close_p()
            self.insert_tag(t)
            self.frameset_ok = False
            self.mode = self.in_table
        elif name not in TABLE_PARTS and name not in ("frame", "head"):
            self.reconstruct()
            self.insert_tag(t)
        return False

    def body_end(self, t: tuple) -> bool:
        name = t[1]
        if name in BLOCK_ENDS:
            if self.in_scope(name):
                self.implied()
                self.pop_until(name)
        elif name == "p":
            if not self.in_scope("p", ("button",)):
                self.insert("p", [])
            self.implied("p")
            self.pop_until("p")
        elif name in FORMATTING:
            self.adopt(name)
        elif name == "li":
            if self.in_scope("li", ("ol", "ul")):
                self.implied("li")
                self.pop_until("li")
        elif name in ("dd", "dt"):
            if self.in_scope(name):
                self.implied(name)
                self.pop_until(name)
        elif name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.implied()
                self.pop_until(*HEADINGS)
        elif name in ("body", "html"):
            if self.in_scope("body"):
                self.mode = self.after_body
                return name == "html"
        elif name == "template":
            return self.in_head(t)
        elif name == "form":
            if self._special_context():
                if self.in_scope("form"):
                    self.implied()
                    self.pop_until("form")
            else:
                n, self.form = self.form, None
                if n is not None and self.node_in_scope(n):
                    self.implied()
                    self._remove_open(n)
        elif name in ("applet", "marquee", "object"):
            if self.in_scope(name):
                self.implied()
                self.pop_until(name)
                self.clear_active()
        elif name == "br":
            return self.body_start(("start", "br", [], False))
        else:
            self.other_end(name)
        return False

    def text(self, t: tuple) -> bool:
        if t[0] == "text":
            self.insert_text(t[1])
            return False
        self.open.pop()
        self.mode = self.original
        return t[0] == "eof"

    def _anything_in_table(self, t: tuple) -> bool:
        self.fostering = True
        again = self.in_body(t)
        self.fostering = False
        return again

    def clear_to(self, *names: str) -> None:
        while not self._is(self.open[-1], *names, "template", "html"):
            self.open.pop()

    def in_table(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "text":
            if self._is(self.open[-1], "table", "tbody", "template", "tfoot", "thead", "tr"):
                self.pending_text = []
                self.original, self.mode = self.mode, self.in_table_text
                return True
            return self._anything_in_table(t)
        if k in ("comment", "pi"):
            self.comment(t)
            return False
        if k == "doctype":
            return False
        if k == "start":
            if name == "caption":
                self.clear_to("table")
                self.active.append(MARKER)
                self.insert_tag(t)
                self.mode = self.in_caption
                return False
            if name in ("colgroup", "col"):
                self.clear_to("table")
                self.insert("colgroup", t[2] if name == "colgroup" else [])
                self.mode = self.in_column_group
                return name == "col"
            if name in ("tbody", "tfoot", "thead", "td", "th", "tr"):
                self.clear_to("table")
                whole = name[0] != "t" or name in ("tbody", "tfoot", "thead")
                self.insert(name if whole else "tbody", t[2] if whole else [])
                self.mode = self.in_table_body
                return not whole
            if name == "table":
                if self.in_table_scope("table"):
                    self.pop_until("table")
                    self.reset_mode()
                    return True
                return False
            if name in ("style", "script", "template"):
                return self.in_head(t)
            if name == "input" and ascii_lower(next((v for n, v in t[2] if n == "type"), "")) == "hidden":
                self.insert_void(t)
                return False
            if name == "form":
                if not self.has_template() and self.form is None:
                    self.form = self.insert_tag(t)
                    self.open.pop()
                return False
        elif k == "end":
            if name == "table":
                if self.in_table_scope("table"):
                    self.pop_until("table")
                    self.reset_mode()
                return False
            if name in TABLE_PARTS or name in ("body", "html"):
                return False
            if name == "template":
                return self.in_head(t)
        elif k == "eof":
            return self.in_body(t)
        return self._anything_in_table(t)

    def in_table_text(self, t: tuple) -> bool:
        if t[0] == "text":
            self.pending_text.append(t[1].replace("\0", ""))
            return False
        text = "".join(self.pending_text)
        self.mode = self.original
        if _NON_SPACE.search(text):
            self._anything_in_table(("text", text))
        else:
            self.insert_text(text)
        return True

    def _leave_caption(self) -> bool:
        if not self.in_table_scope("caption"):
            return False
        self.implied()
        self.pop_until("caption")
        self.clear_active()
        self.mode = self.in_table
        return True

    def in_caption(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "end" and name == "caption":
            self._leave_caption()
            return False
        if (k == "start" and name in TABLE_PARTS) or (k == "end" and name == "table"):
            return self._leave_caption()
        if k == "end" and name in (TABLE_PARTS | {"body", "html"}):
            return False
        return self.in_body(t)

    def in_column_group(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "text":
            lead = _LEAD.match(name).end()
            if lead:
                self.insert_text(name[:lead])
            if lead == len(name):
                return False
            if not self._is(self.open[-1], "colgroup"):
                return False
            self.open.pop()
            self.mode = self.in_table
            return self._without_lead(t)
        if k in ("comment", "pi"):
            self.comment(t)
            return False
        if k == "doctype":
            return False
        if k == "start" and name == "html":
            return self.in_body(t)
        if k == "start" and name == "col":
            self.insert_void(t)
            return False
        if k == "end" and name == "colgroup":
            if self._is(self.open[-1], "colgroup"):
                self.open.pop()
                self.mode = self.in_table
            return False
        if k == "end" and name == "col":
            return False
        if k in ("start", "end") and name == "template":
            return self.in_head(t)
        if k == "eof":
            return self.in_body(t)
        if not self._is(self.open[-1], "colgroup"):
            return False
        self.open.pop()
        self.mode = self.in_table
        return True

    def in_table_body(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "start":
            if name in ("tr", "td", "th"):
                self.clear_to("tbody", "tfoot", "thead")
                self.insert("tr", t[2] if name == "tr" else [])
                self.mode = self.in_row
                return name != "tr"
            if name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead"):
                return self._leave_body()
        elif k == "end":
            if name in ("tbody", "tfoot", "thead"):
                if self.in_table_scope(name):
                    self.clear_to("tbody", "tfoot", "thead")
                    self.open.pop()
                    self.mode = self.in_table
                return False
            if name == "table":
                return self._leave_body()
            if name in ("body", "caption", "col", "colgroup", "html", "td", "th", "tr"):
                return False
        return self.in_table(t)

    def _leave_body(self) -> bool:
        if not self.in_table_scope("tbody", "thead", "tfoot"):
            return False
        self.clear_to("tbody", "tfoot", "thead")
        self.open.pop()
        self.mode = self.in_table
        return True

    def _leave_row(self) -> bool:
        if not self.in_table_scope("tr"):
            return False
        self.clear_to("tr")
        self.open.pop()
        self.mode = self.in_table_body
        return True

    def in_row(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "start":
            if name in ("td", "th"):
                self.clear_to("tr")
                self.insert_tag(t)
                self.mode = self.in_cell
                self.active.append(MARKER)
                return False
            if name in ("caption", "col", "colgroup", "tbody", "tfoot", "thead", "tr"):
                return self._leave_row()
        elif k == "end":
            if name == "tr":
                self._leave_row()
                return False
            if name == "table":
                return self._leave_row()
            if name in ("tbody", "tfoot", "thead"):
                return self.in_table_scope(name) and self._leave_row()
            if name in ("body", "caption", "col", "colgroup", "html", "td", "th"):
                return False
        return self.in_table(t)

    def _close_cell(self) -> None:
        self.implied()
        self.pop_until("td", "th")
        self.clear_active()
        self.mode = self.in_row

    def in_cell(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "end" and name in ("td", "th"):
            if self.in_table_scope(name):
                self.implied()
                self.pop_until(name)
                self.clear_active()
                self.mode = self.in_row
            return False
        if k == "start" and name in TABLE_PARTS:
            if self.in_table_scope("td", "th"):
                self._close_cell()
                return True
            return False
        if k == "end" and name in ("body", "caption", "col", "colgroup", "html"):
            return False
        if k == "end" and name in TABLE_HOSTS:
            if self.in_table_scope(name):
                self._close_cell()
                return True
            return False
        return self.in_body(t)

    def in_template(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k in ("text", "comment", "pi", "doctype"):
            return self.in_body(t)
        if k == "start":
            if name in HEAD_START:
                return self.in_head(t)
            to = {"col": self.in_column_group, "tr": self.in_table_body, "td": self.in_row, "th": self.in_row} | dict.fromkeys(("caption", "colgroup", "tbody", "tfoot", "thead"), self.in_table)
            self.mode = self.template_modes[-1] = to.get(name, self.in_body)
            return True
        if k == "end":
            return self.in_head(t) if name == "template" else False
        if not self.has_template():
            return False
        self.close_template()
        return True

    def after_body(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "text":
            lead = _LEAD.match(name).end()
            if lead:
                self.in_body(("text", name[:lead]))
            if lead == len(name):
                return False
            self.mode = self.in_body
            return self._without_lead(t)
        if k in ("comment", "pi"):
            self.comment(t, self.open[0])
            return False
        if k == "doctype":
            return False
        if k == "start" and name == "html":
            return self.in_body(t)
        if k == "end" and name == "html":
            if self.context is None:
                self.mode = self.after_after_body
            return False
        if k == "eof":
            return False
        self.mode = self.in_body
        return True

    def _spaces(self, t: tuple) -> None:
        self.insert_text("".join(c for c in t[1] if c in "\t\n\f\r "))

    def in_frameset(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "text":
            self._spaces(t)
        elif k in ("comment", "pi"):
            self.comment(t)
        elif k == "start":
            if name == "html":
                return self.in_body(t)
            if name == "frameset":
                self.insert_tag(t)
            elif name == "frame":
                self.insert_void(t)
            elif name == "noframes":
                return self.in_head(t)
        elif k == "end" and name == "frameset" and len(self.open) > 1:
            self.open.pop()
            if self.context is None and not self._is(self.open[-1], "frameset"):
                self.mode = self.after_frameset
        return False

    def after_frameset(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k == "text":
            self._spaces(t)
        elif k in ("comment", "pi"):
            self.comment(t)
        elif k == "start" and name == "html":
            return self.in_body(t)
        elif k == "start" and name == "noframes":
            return self.in_head(t)
        elif k == "end" and name == "html":
            self.mode = self.after_after_frameset
        return False

    def after_after_body(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k in ("comment", "pi"):
            self.comment(t, self.doc)
            return False
        if k == "text":
            lead = _LEAD.match(name).end()
            if lead:
                self.in_body(("text", name[:lead]))
            if lead == len(name):
                return False
            self.mode = self.in_body
            return self._without_lead(t)
        if k == "doctype":
            return False
        if k == "start" and name == "html":
            return self.in_body(t)
        if k == "eof":
            return False
        self.mode = self.in_body
        return True

    def after_after_frameset(self, t: tuple) -> bool:
        k, name = t[0], t[1] if len(t) > 1 else ""
        if k in ("comment", "pi"):
            self.comment(t, self.doc)
        elif k == "text":
            spaces = "".join(c for c in name if c in "\t\n\f\r ")
            if spaces:
                self.in_body(("text", spaces))
        elif k == "start" and name == "html":
            return self.in_body(t)
        elif k == "start" and name == "noframes":
            return self.in_head(t)
        return False

    def reset_mode(self) -> None:
        to = {"tr": self.in_row, "tbody": self.in_table_body, "thead": self.in_table_body, "tfoot": self.in_table_body, "caption": self.in_caption, "colgroup": self.in_column_group, "table": self.in_table, "body": self.in_body, "frameset": self.in_frameset}
        for i in range(len(self.open) - 1, -1, -1):
            last = i == 0
            n = self.context if last and self.context is not None else self.open[i]
            if n.ns == HTML:
                if n.name in ("td", "th") and not last:
                    self.mode = self.in_cell
                    return
                if n.name == "head" and not last:
                    self.mode = self.in_head
                    return
                if n.name == "template":
                    self.mode = self.template_modes[-1]
                    return
                if n.name == "html":
                    self.mode = self.before_head if self.head is None else self.after_head
                    return
                if n.name in to:
                    self.mode = to[n.name]
                    return
            if last:
                self.mode = self.in_body
                return

    # foreign content

    def insert_foreign(self, t: tuple, ns: str) -> None:
        names = SVG_ATTRS if ns == SVG else {"definitionurl": "definitionURL"}
        attrs = []
        for n, v in t[2]:
            n = names.get(n, n)
            attrs.append((*FOREIGN_ATTRS[n], v) if n in FOREIGN_ATTRS else ("", n, v))
        self.insert(t[1], attrs, ns)
        if t[3]:
            self.open.pop()

    def foreign(self, t: tuple) -> bool:
        k = t[0]
        if k == "text":
            if _NON_SPACE.search(t[1].replace("\0", "")):
                self.frameset_ok = False
            self.insert_text(t[1].replace("\0", "�"))
            return False
        if k in ("comment", "pi"):
            self.comment(t)
            return False
        if k == "doctype":
            return False
        name = t[1]
        out = name in BREAKOUT or (name == "font" and any(n in ("color", "face", "size") for n, _ in t[2]))
        if (k == "start" and out) or (k == "end" and name in ("br", "p")):
            while self.open and not (self.open[-1].ns == HTML or self._math_text(self.open[-1]) or self._html_point(self.open[-1])):
                self.open.pop()
            return self.mode(t)
        if k == "start":
            ns = self._adjusted().ns
            self.insert_foreign(("start", SVG_TAGS.get(name, name), t[2], t[3]) if ns == SVG else t, ns)
            return False
        i = len(self.open) - 1
        while i:
            if ascii_lower(self.open[i].name) == name:
                del self.open[i:]
                return False
            i -= 1
            if self.open[i].ns == HTML:
                return self.mode(t)
        return False

    def _fill_selectedcontent(self) -> None:
        for select in [n for n in descendants(self.doc) if self._is(n, "select")]:
            inside = list(descendants(select))
            target = next((n for n in inside if self._is(n, "selectedcontent")), None)
            options = [n for n in inside if self._is(n, "option")]
            chosen = next((n for n in reversed(options) if n.get("selected") is not None), options[0] if options else None)
            if target is not None and chosen is not None:
                target.kids = []
                for kid in list(chosen.kids):
                    target.add(clone(kid))


def descendants(root: Node):
    """Nodes below root in document order, without template contents and shadow trees."""
    stack = list(reversed(root.kids))
    while stack:
        n = stack.pop()
        yield n
        stack.extend(reversed(n.kids))


def clone(root: Node) -> Node:
    """A copy of a subtree, with template contents and without shadow roots."""

    def one(n: Node) -> Node:
        c = Node(n.kind, n.name, n.ns, list(n.attrs) if n.attrs is not None else None, n.data)
        c.extra = n.extra
        return c

    top = one(root)
    work = [(root, top)]
    while work:
        a, b = work.pop()
        for kid in a.kids:
            c = one(kid)
            b.add(c)
            work.append((kid, c))
        if a.content is not None and a.content.kind == "fragment":
            b.content = Node("fragment")
            work.append((a.content, b.content))
    return top


def parse(source: str, options: Options | None = None) -> TreeBuilder:
    return TreeBuilder(source, options).run()


def parse_fragment(source: str, ns: str, name: str, options: Options | None = None) -> Node:
    """The children of a fragment's root are the fragment."""
    return TreeBuilder(source, options, (ns, name)).run().doc.kids[0]


def dump(root: Node) -> str:
    """The tree as indented lines, attributes in order of their names."""
    out: list[str] = []
    work: list[tuple] = [(k, 0) for k in reversed(root.kids)]
    while work:
        n, depth = work.pop()
        pad = "| " + "  " * depth
        if isinstance(n, str):
            out.append(pad + n)
            continue
        if n.kind == "element":
            out.append(f"{pad}<{PREFIX[n.ns]}{n.name}>")
            for a in sorted((f"{ns} {x}" if ns else x, v) for ns, x, v in n.attrs):
                out.append(f'{pad}  {a[0]}="{a[1]}"')
            more: list[tuple] = []
            if n.shadow is not None:
                more.append((f"#shadow-root ({n.shadow.extra[0]})", depth + 1))
                more += [(k, depth + 2) for k in n.shadow.kids]
            if n.content is not None:
                more.append(("content", depth + 1))
                more += [(k, depth + 2) for k in n.content.kids]
            more += [(k, depth + 1) for k in n.kids]
            work += reversed(more)
        elif n.kind == "text":
            out.append(f'{pad}"{n.data}"')
        elif n.kind == "comment":
            out.append(f"{pad}<!-- {n.data} -->")
        elif n.kind == "pi":
            out.append(f"{pad}<?{n.name} {n.data}?>")
        elif n.kind == "doctype":
            ids = f' "{n.extra[0]}" "{n.extra[1]}"' if any(n.extra) else ""
            out.append(f"{pad}<!DOCTYPE {n.name}{ids}>")
    return "\n".join(out)
