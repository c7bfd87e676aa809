"""HTML tokens by the error-recovery rules of the HTML Standard; regular expressions jump from stop to stop.

A token is a tuple: ("text", data), ("start", name, attrs, self_closing), ("end", name, attrs, self_closing),
("comment", data), ("pi", target, data), ("doctype", name, public, system, force_quirks) or ("eof",);
attrs is a list of (name, value), each name once, the first of equal names.
"""

from __future__ import annotations

import re
from html.entities import html5

_STOP = re.compile("[<&]")
_AMP = re.compile("&")
_TAG_NAME = re.compile(r"[a-zA-Z][^\t\n\f />]*")
_SKIP = re.compile(r"[\t\n\f /]*")
_WS = re.compile(r"[\t\n\f ]*")
_ATTR = re.compile(r"(=?[^\t\n\f />=]*)(?:[\t\n\f ]*=[\t\n\f ]*(?:\"([^\"]*)\"|'([^']*)'|(?=[\"'])|(?=>)|([^\t\n\f >]*)))?")
_REF = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([a-zA-Z0-9]+);?)")
_COMMENT_END = re.compile(r"--!?>")
_COMMENT_TAIL = re.compile(r"(?:--!?|-)\Z")
_PI = re.compile(r"\?([a-zA-Z_][a-zA-Z0-9_-]*)(?=[\t\n\f >?])")
_SCRIPT_ESCAPE = re.compile(r"<!--|</script(?=[\t\n\f />])", re.I | re.A)
_SCRIPT_INSIDE = re.compile(r"--+>|</script(?=[\t\n\f />])|<script(?=[\t\n\f />])", re.I | re.A)
_SCRIPT_TWICE = re.compile(r"--+>|</script(?=[\t\n\f />])", re.I | re.A)
_end_tags: dict[str, re.Pattern] = {}
_LONGEST = max(len(k) for k in html5 if not k.endswith(";"))
_UPPER = {i: i + 32 for i in range(65, 91)}


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(_UPPER)


def char_ref(code: int) -> str:
    if code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        return "�"
    if 0x80 <= code <= 0x9F:
        try:
            return bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(code)
    return chr(code)


def decode(s: str, attribute: bool = False) -> str:
    """s with its character references replaced."""
    if "&" not in s:
        return s
    out, at = [], 0
    for m in iter(lambda: _REF.search(s, at), None):
        start, end = m.span()
        out.append(s[at:start])
        hexa, digits, name = m.groups()
        if name is None:
            out.append(char_ref(int(hexa, 16) if hexa else int(digits)) if len(hexa or digits) < 4000 else "�")
            at = end
            continue
        got = None
        if s[end - 1] == ";" and name + ";" in html5:
            got, at = html5[name + ";"], end
        else:
            for n in range(min(len(name), _LONGEST), 1, -1):
                if name[:n] in html5:
                    after = s[start + 1 + n : start + 2 + n]
                    if not (attribute and (after == "=" or (after.isascii() and after.isalnum()))):
                        got, at = html5[name[:n]], start + 1 + n
                    break
        if got is None:
            got, at = s[start : start + 1 + len(name)], start + 1 + len(name)
        out.append(got)
    out.append(s[at:])
    return "".join(out)


def newlines(s: str) -> str:
    return s.replace("\r\n", "\n").replace("\r", "\n") if "\r" in s else s


class Lexer:
    """Tokens of one page, one by one. `state` is data, rcdata, rawtext, script or plaintext; a tree builder changes it after a start tag."""

    def __init__(self, source: str, state: str = "data", last_start: str = "", cdata=None):
        self.s = newlines(source)
        self.pos = 0
        self.state = state
        self.last_start = last_start
        self.cdata = cdata or (lambda: False)
        self.pending = None

    def __iter__(self):
        while True:
            t = self.next()
            yield t
            if t[0] == "eof":
                return

    def next(self) -> tuple:
        if self.pending is not None:
            t, self.pending = self.pending, None
            return t
        parts: list[str] = []
        while True:
            t = self._data(parts) if self.state == "data" else self._raw(parts)
            if t is None:
                continue
            text = "".join(parts)
            if text:
                self.pending = t
                return ("text", text)
            return t

    def _rest(self, parts: list[str]) -> tuple:
        parts.append(self.s[self.pos :])
        self.pos = len(self.s)
        return ("eof",)

    def _raw(self, parts: list[str]) -> tuple | None:
        s = self.s
        if self.state == "plaintext":
            parts.append(s[self.pos :].replace("\0", "�"))
            self.pos = len(s)
            return ("eof",)
        end = self._raw_end()
        text = s[self.pos : end].replace("\0", "�")
        parts.append(decode(text) if self.state == "rcdata" else text)
        self.pos = end
        self.state = "data"
        return ("eof",) if end == len(s) else self._end_tag(end + 2)

    def _raw_end(self) -> int:
        """Where the end tag of the open raw element begins, or the end."""
        s = self.s
        if self.state != "script":
            if not self.last_start:
                return len(s)
            p = _end_tags.setdefault(self.last_start, re.compile(rf"</{re.escape(self.last_start)}(?=[\t\n\f />])", re.I | re.A))
            m = p.search(s, self.pos)
            return m.start() if m else len(s)
        at, depth = self.pos, 0
        while True:
            m = (_SCRIPT_ESCAPE, _SCRIPT_INSIDE, _SCRIPT_TWICE)[depth].search(s, at)
            if not m:
                return len(s)
            got = m.group()
            at = m.end()
            if got == "<!--":
                depth, at = 1, m.start() + 2
            elif got[0] == "-":
                depth = 0
            elif got[1] == "/":
                if depth < 2:
                    return m.start()
                depth = 1
            else:
                depth = 2

    def _data(self, parts: list[str]) -> tuple | None:
        s = self.s
        m = _STOP.search(s, self.pos)
        if not m:
            return self._rest(parts)
        at = m.start()
        if s[at] == "&":
            lt = s.find("<", at)
            lt = len(s) if lt < 0 else lt
            parts.append(s[self.pos : at] + decode(s[at:lt]))
            self.pos = lt
            return None
        parts.append(s[self.pos : at])
        self.pos = at
        c = s[at + 1 : at + 2]
        if c.isascii() and c.isalpha():
            return self._start_tag(at + 1)
        if c == "/":
            d = s[at + 2 : at + 3]
            if d.isascii() and d.isalpha():
                return self._end_tag(at + 2)
            if d == ">":
                self.pos = at + 3
                return None
            return self._bogus(at + 2) if d else self._rest(parts)
        if c == "!":
            return self._declaration(at + 2, parts)
        if c == "?":
            return self._instruction(at + 1)
        parts.append("<")
        self.pos = at + 1
        return None

    def _start_tag(self, at: int) -> tuple:
        t = self._tag("start", at)
        if t[0] == "start":
            self.last_start = t[1]
        return t

    def _end_tag(self, at: int) -> tuple:
        return self._tag("end", at)

    def _tag(self, kind: str, at: int) -> tuple:
        s, n = self.s, len(self.s)
        m = _TAG_NAME.match(s, at)
        name = ascii_lower(m.group()).replace("\0", "�")
        at = m.end()
        attrs: list[tuple[str, str]] = []
        seen: set[str] | None = None
        while True:
            end = _SKIP.match(s, at).end()
            if end >= n:
                self.pos = n
                return ("eof",)
            if s[end] == ">":
                self.pos = end + 1
                return (kind, name, attrs, s[end - 1] == "/" and end > at)
            m = _ATTR.match(s, end)
            at = m.end()
            key, double, single, bare = m.groups()
            value = double if double is not None else single if single is not None else bare
            if value is None:
                value = ""
                if at < n and s[at] in "\"'" and s[end:at].rstrip("\t\n\f ").endswith("="):  # a quote that never closes
                    self.pos = n
                    return ("eof",)
            key = ascii_lower(key).replace("\0", "�")
            if seen is None:
                seen = set()
            if key not in seen:
                seen.add(key)
                value = value.replace("\0", "�") if "\0" in value else value
                attrs.append((key, decode(value, True)))

    def _bogus(self, at: int) -> tuple:
        end = self.s.find(">", at)
        data = self.s[at:] if end < 0 else self.s[at:end]
        self.pos = len(self.s) if end < 0 else end + 1
        return ("comment", data.replace("\0", "�"))

    def _instruction(self, at: int) -> tuple:
        s = self.s
        m = _PI.match(s, at)
        if not m:
            tail = re.compile(r"\?(?:[a-zA-Z_][a-zA-Z0-9_-]*)?\Z").match(s, at)
            if tail:
                self.pos = len(s)
                return ("eof",)
            return self._bogus(at)
        target = m.group(1)
        if target[:3].lower() == "xml":
            return self._bogus(at)
        begin = _WS.match(s, m.end()).end()
        end = s.find(">", begin)
        self.pos = len(s) if end < 0 else end + 1
        if end < 0:
            return ("eof",)
        data = s[begin:end]
        return ("pi", target, (data[:-1] if data.endswith("?") else data).replace("\0", "�"))

    def _declaration(self, at: int, parts: list[str]) -> tuple | None:
        s = self.s
        if s.startswith("--", at):
            return self._comment(at + 2)
        if s[at : at + 7].lower() == "doctype":
            return self._doctype(at + 7)
        if s.startswith("[CDATA[", at) and self.cdata():
            end = s.find("]]>", at + 7)
            parts.append(s[at + 7 :] if end < 0 else s[at + 7 : end])
            self.pos = len(s) if end < 0 else end + 3
            return None
        return self._bogus(at)

    def _comment(self, at: int) -> tuple:
        s = self.s
        for short in (">", "->"):
            if s.startswith(short, at):
                self.pos = at + len(short)
                return ("comment", "")
        m = _COMMENT_END.search(s, at)
        data = s[at : m.start()] if m else _COMMENT_TAIL.sub("", s[at:])
        self.pos = m.end() if m else len(s)
        return ("comment", data.replace("\0", "�"))

    def _doctype(self, at: int) -> tuple:
        s, n = self.s, len(self.s)
        public = system = None

        def done(end: int, quirks: bool) -> tuple:
            self.pos = end
            return ("doctype", name, public, system, quirks)

        def bogus(at: int, quirks: bool) -> tuple:
            end = s.find(">", at)
            return done(n if end < 0 else end + 1, quirks)

        def quoted(at: int) -> tuple[str, int, bool]:
            q = s[at]
            end = at + 1
            while end < n and s[end] not in (q, ">"):
                end += 1
            return s[at + 1 : end].replace("\0", "�"), min(end + 1, n), end < n and s[end] == q

        name = ""
        at = _WS.match(s, at).end()
        if at >= n or s[at] == ">":
            return done(min(at + 1, n), True)
        end = re.compile(r"[^\t\n\f >]*").match(s, at).end()
        name = ascii_lower(s[at:end]).replace("\0", "�")
        at = _WS.match(s, end).end()
        if at >= n:
            return done(n, True)
        if s[at] == ">":
            return done(at + 1, False)
        word = s[at : at + 6].lower()
        if word not in ("public", "system"):
            return bogus(at, True)
        at = _WS.match(s, at + 6).end()
        if at >= n or s[at] not in "\"'":
            return done(min(at + 1, n), True) if at >= n or s[at] == ">" else bogus(at, True)
        if word == "public":
            public, at, ok = quoted(at)
            if not ok:
                return done(at, True)
            at = _WS.match(s, at).end()
            if at >= n:
                return done(n, True)
            if s[at] == ">":
                return done(at + 1, False)
            if s[at] not in "\"'":
                return bogus(at, True)
        system, at, ok = quoted(at)
        if not ok:
            return done(at, True)
        at = _WS.match(s, at).end()
        if at >= n:
            return done(n, True)
        return done(at + 1, False) if s[at] == ">" else bogus(at, False)


def tokenize(source: str, state: str = "data", last_start: str = "") -> list[tuple]:
    """All tokens of a page, without a tree builder: raw elements don't change the state."""
    return list(Lexer(source, state, last_start))
