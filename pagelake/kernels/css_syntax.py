"""CSS syntax: tokens, component values, declarations, rules and An+B."""

from __future__ import annotations

import re

_ESCAPE = r"\\(?:[0-9a-fA-F]{1,6}[ \t\n]?|[^\n0-9a-fA-F]|\Z)"
_START = rf"(?:[a-zA-Z_]|[^\x00-\x7f]|{_ESCAPE})"
_NAME = rf"(?:[a-zA-Z0-9_-]|[^\x00-\x7f]|{_ESCAPE})"
_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_IDENT = rf"(?:--{_NAME}*|-?{_START}{_NAME}*)"
_TOKEN = re.compile(
    rf"""(?P<comment>/\*(?:.*?\*/|.*\Z))|(?P<ws>[ \t\n]+)|(?P<number>{_NUMBER})|(?P<cdo><!--)|(?P<cdc>-->)|(?P<ident>{_IDENT})
    |(?P<string>["'])|\#(?P<hash>{_NAME}+)|@(?P<at>{_IDENT})|(?P<punct>[:;,\[\](){{}}])|(?P<delim>.)""",
    re.S | re.X,
)
_UNIT = re.compile(_IDENT, re.S)
_ESC = re.compile(_ESCAPE, re.S)
_IS_ID = re.compile(_IDENT + r"\Z", re.S)
_URL_BARE = re.compile(rf"[ \t\n]*((?:[^\x00-\x08\x0b\x0e-\x1f\x7f ()\"'\\\t\n]|{_ESCAPE})*)[ \t\n]*(?:\)|\Z)", re.S)
_BAD_URL = re.compile(r"(?:\\.|[^)\\])*\)?", re.S)
_STRINGS = {q: re.compile(rf"((?:[^{q}\\\n]|\\\n|\\(?:[0-9a-fA-F]{{1,6}}[ \t\n]?|[^\n0-9a-fA-F]|\Z))*)(.?)", re.S) for q in "\"'"}
OPEN = {"(": ")", "[": "]", "{": "}"}
#: Largest number a token can hold.
HUGE = 1.7976931348623157e308


def preprocess(css: str) -> str:
    return re.sub(r"\r\n?|\f", "\n", css).replace("\0", "�")


def unescape(s: str) -> str:
    if "\\" not in s:
        return s

    def one(m: re.Match) -> str:
        body = m.group()[1:]
        if not body:
            return "�"
        if body[0] in "0123456789abcdefABCDEF":
            n = int(body.strip(), 16)
            return "�" if n == 0 or n > 0x10FFFF or 0xD800 <= n <= 0xDFFF else chr(n)
        return body

    return _ESC.sub(one, s)


class Token:
    """kind: ident function at hash string badstring url badurl delim number percentage dimension ws cdo cdc, a punctuation mark,
    or block (value is its opening bracket). Functions and blocks hold kids once values are parsed."""

    __slots__ = ("end", "integer", "kids", "kind", "num", "start", "unit", "value")

    def __init__(self, kind: str, value: str, start: int, end: int, num: float = 0.0, integer: bool = False, unit: str = ""):
        self.kind, self.value, self.start, self.end = kind, value, start, end
        self.num, self.integer, self.unit = num, integer, unit
        self.kids: list[Token] | None = None

    def is_word(self, word: str) -> bool:
        return self.kind == "ident" and self.value.lower() == word

    def is_delim(self, c: str) -> bool:
        return self.kind == "delim" and self.value == c


def tokens(s: str) -> list[Token]:
    """Tokens of preprocessed CSS, comments left out."""
    out: list[Token] = []
    at, n = 0, len(s)
    while at < n:
        m = _TOKEN.match(s, at)
        kind, end = m.lastgroup, m.end()
        if kind == "comment":
            at = end
            continue
        if kind == "number":
            text = m.group()
            num = max(-HUGE, min(HUGE, float(text)))
            integer = not re.search(r"[.eE]", text)
            u = _UNIT.match(s, end)
            if u:
                t = Token("dimension", text, at, u.end(), num, integer, unescape(u.group()))
            elif end < n and s[end] == "%":
                t = Token("percentage", text, at, end + 1, num, integer)
            else:
                t = Token("number", text, at, end, num, integer)
        elif kind == "ident":
            name = unescape(m.group())
            if end < n and s[end] == "(":
                end += 1
                t = _url(s, at, end) if name.lower() == "url" and not re.compile(r"[ \t\n]*[\"']").match(s, end) else Token("function", name, at, end)
            else:
                t = Token("ident", name, at, end)
        elif kind == "string":
            b = _STRINGS[m.group()].match(s, end)
            if b.group(2) == "\n":
                t = Token("badstring", "", at, b.end(1))
            else:
                t = Token("string", unescape(b.group(1).replace("\\\n", "")), at, b.end())
        elif kind == "hash":
            t = Token("hash", unescape(m.group("hash")), at, end, integer=bool(_IS_ID.match(m.group("hash"))))
        elif kind == "at":
            t = Token("at", unescape(m.group("at")), at, end)
        elif kind == "punct":
            t = Token(m.group(), m.group(), at, end)
        else:
            t = Token(kind, m.group(), at, end)
        out.append(t)
        at = t.end
    return out


def _url(s: str, start: int, at: int) -> Token:
    m = _URL_BARE.match(s, at)
    if m:
        return Token("url", unescape(m.group(1)), start, m.end())
    return Token("badurl", "", start, _BAD_URL.match(s, at).end())


def values(toks: list[Token]) -> list[Token]:
    """Component values: blocks and functions hold what is in them; what is left open ends with the text."""
    top: list[Token] = []
    stack: list[tuple[list[Token], str]] = [(top, "")]
    for t in toks:
        if t.kind == "function" or t.kind in OPEN:
            c = Token("function" if t.kind == "function" else "block", t.value, t.start, t.end)
            c.kids = []
            stack[-1][0].append(c)
            stack.append((c.kids, OPEN.get(t.kind, ")")))
        elif len(stack) > 1 and t.kind == stack[-1][1]:
            stack.pop()
            stack[-1][0][-1].end = t.end
        else:
            stack[-1][0].append(t)
    return top


def parse_values(s: str) -> list[Token]:
    return values(tokens(s))


def no_space(vals: list[Token]) -> list[Token]:
    return [v for v in vals if v.kind != "ws"]


def split_commas(vals: list[Token]) -> list[list[Token]]:
    out: list[list[Token]] = [[]]
    for v in vals:
        if v.kind == ",":
            out.append([])
        else:
            out[-1].append(v)
    return out


# serialising


def css_ident(s: str) -> str:
    out = []
    for i, c in enumerate(s):
        if c == "\0":
            out.append("�")
        elif "\x01" <= c <= "\x1f" or c == "\x7f" or (c.isascii() and c.isdigit() and (i == 0 or (i == 1 and s[0] == "-"))):
            out.append(f"\\{ord(c):x} ")
        elif c == "-" and len(s) == 1:
            out.append("\\-")
        elif not c.isascii() or c.isalnum() or c in "-_":
            out.append(c)
        else:
            out.append("\\" + c)
    return "".join(out)


def css_string(s: str) -> str:
    return '"' + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"\\{ord(m.group()):x} ", s.replace("\\", "\\\\").replace('"', '\\"')) + '"'


def to_css(vals: list[Token]) -> str:
    out = []
    for v in vals:
        if v.kind == "function":
            out.append(f"{css_ident(v.value)}({to_css(v.kids or [])})")
        elif v.kind == "block":
            out.append(v.value + to_css(v.kids) + OPEN[v.value])
        elif v.kind == "ident":
            out.append(css_ident(v.value))
        elif v.kind == "at":
            out.append("@" + css_ident(v.value))
        elif v.kind == "hash":
            out.append("#" + (css_ident(v.value) if v.integer else v.value))
        elif v.kind == "string":
            out.append(css_string(v.value))
        elif v.kind == "url":
            out.append(f"url({css_string(v.value)})")
        elif v.kind == "dimension":
            out.append(v.value + css_ident(v.unit))
        elif v.kind == "percentage":
            out.append(v.value + "%")
        else:
            out.append(" " if v.kind == "ws" else v.value)
    return "".join(out)


# declarations with the text of their values


def nesting(t: Token) -> int:
    return 1 if t.kind == "function" or t.kind in OPEN else -1 if t.kind in (")", "]", "}") else 0


def raw_declarations(s: str) -> list[tuple[str, str, bool]]:
    """(name, text of the value, important) of each declaration of a block; pieces that are none are left out."""
    out, part, depth = [], [], 0
    for t in tokens(s):
        if t.kind == ";" and depth == 0:
            out.append(part)
            part = []
        else:
            part.append(t)
            depth = max(0, depth + nesting(t))
    out.append(part)
    return [d for d in map(lambda p: _declaration(s, p), out) if d]


def _declaration(s: str, part: list[Token]) -> tuple[str, str, bool] | None:
    solid = no_space(part)
    if len(solid) < 2 or solid[0].kind != "ident" or solid[1].kind != ":":
        return None
    value = solid[2:]
    important = len(value) >= 2 and value[-1].is_word("important") and value[-2].is_delim("!")
    if important:
        value = value[:-2]
    return solid[0].value, s[value[0].start : value[-1].end] if value else "", important


# generic rules


def _rule_at(vals: list[Token], i: int) -> tuple[dict | None, int]:
    """(the rule that begins at vals[i], None if its block is missing; where it ends)."""
    at = vals[i].kind == "at"
    j = i + at
    while j < len(vals) and not (vals[j].kind == "block" and vals[j].value == "{") and not (at and vals[j].kind == ";"):
        j += 1
    block = vals[j].kids if j < len(vals) and vals[j].kind == "block" else None
    if not at and block is None:
        return None, j
    return {"kind": "at" if at else "style", "name": vals[i].value if at else None, "prelude": vals[i + at : j], "block": block}, j + 1


def parse_rules(s: str, top: bool = True) -> list[dict]:
    """Rules of a stylesheet (top: CDO and CDC are skipped): kind at or style, name, prelude and block as component values, block None if there is none."""
    vals = parse_values(s)
    out, i = [], 0
    while i < len(vals):
        if vals[i].kind == "ws" or (top and vals[i].kind in ("cdo", "cdc")):
            i += 1
            continue
        rule, i = _rule_at(vals, i)
        if rule is not None:
            out.append(rule)
    return out


def parse_rule(s: str) -> tuple[dict | None, str | None]:
    """(the one rule that a text is, None) or (None, why it is none: empty, invalid or extra input)."""
    vals = parse_values(s)
    begin = next((i for i, v in enumerate(vals) if v.kind != "ws"), None)
    if begin is None:
        return None, "empty"
    rule, end = _rule_at(vals, begin)
    if rule is None:
        return None, "invalid"
    return (None, "extra input") if no_space(vals[end:]) else (rule, None)


def parse_one_declaration(s: str) -> tuple[tuple[str, list[Token], bool] | None, str | None]:
    """(the one declaration that a text is, None) or (None, why it is none: empty or invalid)."""
    vals = parse_values(s)
    if not no_space(vals):
        return None, "empty"
    got = parse_declaration(vals)
    return got, None if got is not None else "invalid"


def parse_declaration(vals: list[Token]) -> tuple[str, list[Token], bool] | None:
    vals = list(vals)
    while vals and vals[0].kind == "ws":
        vals.pop(0)
    if not vals or vals[0].kind != "ident":
        return None
    name = vals.pop(0).value
    while vals and vals[0].kind == "ws":
        vals.pop(0)
    if not vals or vals.pop(0).kind != ":":
        return None
    solid = [i for i, v in enumerate(vals) if v.kind != "ws"]
    important = len(solid) > 1 and vals[solid[-1]].is_word("important") and vals[solid[-2]].is_delim("!")
    if important:
        vals = vals[: solid[-2]]
    while vals and vals[-1].kind == "ws":
        vals.pop()
    while vals and vals[0].kind == "ws":
        vals.pop(0)
    return name, vals, important


def block_contents(vals: list[Token]) -> list[dict]:
    """Declarations and nested rules of a block, in order: at-rules, then what parses as a declaration, then what has a block."""
    out, i = [], 0
    while i < len(vals):
        v = vals[i]
        if v.kind in ("ws", ";"):
            i += 1
            continue
        if v.kind == "at":
            j = i + 1
            while j < len(vals) and vals[j].kind != ";" and not (vals[j].kind == "block" and vals[j].value == "{"):
                j += 1
            block = vals[j].kids if j < len(vals) and vals[j].kind == "block" else None
            out.append({"kind": "at", "name": v.value, "prelude": vals[i + 1 : j], "block": block})
            i = j + 1
            continue
        j = i
        while j < len(vals) and vals[j].kind != ";":
            j += 1
        d = parse_declaration(vals[i:j])
        curly = next((k for k in range(i, j) if vals[k].kind == "block" and vals[k].value == "{"), None)
        mixed = d is not None and not d[0].startswith("--") and any(x.kind == "block" and x.value == "{" for x in d[1]) and len(no_space(d[1])) > 1
        if d is not None and not mixed:
            out.append({"kind": "declaration", "name": d[0], "value": d[1], "important": d[2]})
            i = j + 1
        elif curly is not None:
            out.append({"kind": "style", "name": None, "prelude": vals[i:curly], "block": vals[curly].kids})
            i = curly + 1
        else:
            i = j + 1
    return out


# An+B

_NTH = re.compile(r"(?:(?P<word>odd|even)|(?P<a>[+-]?[0-9]*)n(?:[ \t\n]*(?P<sign>[+-])[ \t\n]*(?P<b>[0-9]+))?|(?P<only>[+-]?[0-9]+))\Z", re.I)


def an_plus_b(vals: list[Token]) -> tuple[int, int] | None:
    """(a, b) of An+B, or None."""
    vals = list(vals)
    while vals and vals[0].kind == "ws":
        vals.pop(0)
    while vals and vals[-1].kind == "ws":
        vals.pop()
    if not vals:
        return None
    if vals[0].is_delim("+") and (len(vals) < 2 or vals[1].kind != "ident" or vals[1].value[:1].lower() not in ("n", "o", "e")):
        return None
    for v in vals:
        if v.kind not in ("number", "dimension", "ident", "ws", "delim") or (v.kind in ("number", "dimension") and not v.integer):
            return None
    for x, y in zip(vals, vals[1:], strict=False):
        if x.kind == "ws" and y.kind == "number" and y.value[0] not in "+-" and not any(v.is_delim("+") or v.is_delim("-") or (v.kind in ("ident", "dimension") and (v.unit or v.value).endswith("-")) for v in vals):
            return None
        if x.is_delim("+") and y.kind == "number" and y.value[0] in "+-":
            return None
    text = "".join(v.value + v.unit if v.kind == "dimension" else " " if v.kind == "ws" else v.value for v in vals)
    m = _NTH.match(text)
    if not m or (text[0] == "+" and m.group("word")):
        return None
    if m.group("word"):
        return (2, 1) if m.group("word").lower() == "odd" else (2, 0)
    if m.group("only"):
        return 0, int(m.group("only"))
    a = m.group("a")
    b = int(m.group("sign") + m.group("b")) if m.group("b") else 0
    return (int(a) if a not in ("", "+", "-") else -1 if a == "-" else 1), b
