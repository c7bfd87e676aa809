"""Selectors: parsing, specificity, and matching against a tree.

A list is a list of complex selectors (compound, [(combinator, compound), ...]) with the rest from right to left; a compound is
(simples, pseudo-element or None). Simples: ("*",), ("type", name), ("id", x), ("class", x), ("attr", name, op, value, flag),
("state", name), ("nth", a, b, from_end, of_type, list), ("not" | "is" | "where", list), ("never", name), ("host", list).
"""

from __future__ import annotations

import re

from .css_syntax import Token, an_plus_b, no_space, parse_values, preprocess, split_commas
from .html_lexer import ascii_lower

# Pseudo-classes of structure, those that never hold here, old pseudo-elements, and
# attributes whose values HTML compares without regard to case.
STRUCTURE = ("root", "empty", "first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type")
NEVER = ("hover", "active", "focus", "focus-within", "focus-visible", "visited", "target")
OLD_ELEMENTS = ("before", "after", "first-line", "first-letter")
NO_CASE = frozenset(
    (
        "accept accept-charset align alink axis bgcolor charset checked clear codetype color compact declare defer dir direction disabled enctype face frame "
        "hreflang http-equiv lang language link media method multiple nohref noresize noshade nowrap readonly rel rev rules scope scrolling selected shape "
        "target text type valign valuetype vlink"
    ).split()
)
_BLANK = re.compile(r"[ \t\n\f\r]")


def parse_selectors(text: str) -> list | None:
    return parse_selector_list(parse_values(preprocess(text)))


def parse_selector_list(vals: list[Token]) -> list | None:
    """The selectors, or None if one of them is invalid."""
    out = [_complex(p) for p in split_commas(vals)]
    return None if None in out else out


def _forgiving(vals: list[Token]) -> list:
    return [c for c in map(_complex, split_commas(vals)) if c is not None]


def _complex(vals: list[Token]):
    parts: list = []
    joins: list[str] = []
    i, n = 0, len(vals)
    while True:
        spaced = i < n and vals[i].kind == "ws"
        while i < n and vals[i].kind == "ws":
            i += 1
        if i == n:
            break
        join = " "
        if vals[i].kind == "delim" and vals[i].value in ">+~":
            join = vals[i].value
            i += 1
            while i < n and vals[i].kind == "ws":
                i += 1
            if not parts or i == n:
                return None
        elif parts and not spaced:
            return None
        if parts and parts[-1][1] is not None:
            return None
        got = _compound(vals, i)
        if got is None:
            return None
        if parts:
            joins.append(join)
        compound, i = got
        parts.append(compound)
    if not parts:
        return None
    return parts[-1], list(zip(reversed(joins), reversed(parts[:-1]), strict=True))


def _compound(vals: list[Token], i: int):
    simples: list = []
    pseudo = None
    n = len(vals)
    if vals[i].kind == "ident":
        simples.append(("type", vals[i].value))
        i += 1
    elif vals[i].is_delim("*"):
        simples.append(("*",))
        i += 1
    if i < n and vals[i].is_delim("|"):
        return None
    while i < n and pseudo is None:
        v = vals[i]
        if v.kind == "hash" and v.integer:
            simples.append(("id", v.value))
            i += 1
        elif v.is_delim("."):
            if i + 1 >= n or vals[i + 1].kind != "ident":
                return None
            simples.append(("class", vals[i + 1].value))
            i += 2
        elif v.kind == "block" and v.value == "[":
            a = _attribute(v.kids)
            if a is None:
                return None
            simples.append(a)
            i += 1
        elif v.kind == ":":
            i += 1
            element = i < n and vals[i].kind == ":"
            i += element
            if i >= n:
                return None
            v = vals[i]
            i += 1
            if v.kind == "ident" and (element or v.value.lower() in OLD_ELEMENTS):
                pseudo = v.value.lower()
                continue
            s = None if element else _pseudo(v)
            if s is None:
                return None
            simples.append(s)
        else:
            break
    return ((simples, pseudo), i) if simples or pseudo else None


def _attribute(kids: list[Token]):
    items = no_space(kids)
    if not items or items[0].kind != "ident":
        return None
    name = items[0].value
    if len(items) == 1:
        return "attr", name, None, None, None
    if items[1].is_delim("="):
        op, rest = "=", items[2:]
    elif len(items) > 2 and items[1].kind == "delim" and items[1].value in "~|^$*" and items[2].is_delim("=") and items[1].end == items[2].start:
        op, rest = items[1].value + "=", items[3:]
    else:
        return None
    if not rest or rest[0].kind not in ("ident", "string") or len(rest) > 2:
        return None
    flag = None
    if len(rest) == 2:
        if rest[1].kind != "ident" or rest[1].value.lower() not in ("i", "s"):
            return None
        flag = rest[1].value.lower()
    return "attr", name, op, rest[0].value, flag


def _pseudo(v: Token):
    name = v.value.lower()
    if v.kind == "ident":
        return ("state", name) if name in STRUCTURE else ("never", name) if name in NEVER else ("host", None) if name == "host" else None
    if v.kind != "function":
        return None
    if name in ("not", "host"):
        got = parse_selector_list(v.kids)
        if got is None or (name == "host" and (len(got) != 1 or got[0][1] or got[0][0][1] is not None)):
            return None
        return name, got
    if name in ("is", "where"):
        return name, _forgiving(v.kids)
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        of_type = name.endswith("of-type")
        of = next((i for i, k in enumerate(v.kids) if k.is_word("of")), None)
        if of is not None and of_type:
            return None
        only = None if of is None else parse_selector_list(v.kids[of + 1 :])
        ab = an_plus_b(v.kids[:of])
        if ab is None or (of is not None and only is None):
            return None
        return "nth", *ab, name.startswith("nth-last"), of_type, only
    return None


def _most(selectors: list) -> tuple[int, int, int]:
    return max(map(specificity, selectors), default=(0, 0, 0))


def specificity(c) -> tuple[int, int, int]:
    a = b = k = 0
    for simples, pseudo in [c[0], *(p for _, p in c[1])]:
        k += pseudo is not None
        for s in simples:
            kind = s[0]
            if kind == "id":
                a += 1
            elif kind == "type":
                k += 1
            elif kind in ("not", "is"):
                x = _most(s[1])
                a, b, k = a + x[0], b + x[1], k + x[2]
            elif kind not in ("*", "where"):
                x = _most((s[5] if kind == "nth" else s[1] if kind == "host" else None) or [])
                a, b, k = a + x[0], b + 1 + x[1], k + x[2]
    return a, b, k


# matching in a tree of html_tree.Node


class Index:
    """Element siblings of the nodes of a tree, looked up once."""

    def __init__(self):
        self.known: dict[int, tuple] = {}

    def place(self, n) -> tuple[list, int]:
        """(elements among n's siblings, place of n)."""
        got = self.known.get(id(n))
        if got is None:
            row = [k for k in n.parent.kids if k.kind == "element"] if n.parent is not None else [n]
            for i, k in enumerate(row):
                self.known[id(k)] = (row, i, k)
            got = self.known[id(n)]
        return got[0], got[1]


def matches_list(selectors: list, n, ix: Index) -> bool:
    return any(matches(c, n, ix) for c in selectors)


def matches(c, n, ix: Index) -> bool:
    (simples, pseudo), rest = c
    return pseudo is None and all(_simple(s, n, ix) for s in simples) and _rest(rest, 0, n, ix)


def matches_host(c, host, ix: Index) -> bool:
    """Whether a selector in a shadow tree's sheet means its host: only :host and :host(x) do."""
    (simples, pseudo), rest = c
    if rest or pseudo is not None or len(simples) != 1 or simples[0][0] != "host":
        return False
    return simples[0][1] is None or matches_list(simples[0][1], host, ix)


def _rest(rest: list, at: int, n, ix: Index) -> bool:
    if at == len(rest):
        return True
    join, (simples, _) = rest[at]
    if join in " >":
        n = n.parent
        while n is not None and n.kind == "element":
            if all(_simple(s, n, ix) for s in simples) and _rest(rest, at + 1, n, ix):
                return True
            if join == ">":
                return False
            n = n.parent
        return False
    row, i = ix.place(n)
    for k in range(i - 1, max(-1, i - 2) if join == "+" else -1, -1):
        if all(_simple(s, row[k], ix) for s in simples) and _rest(rest, at + 1, row[k], ix):
            return True
    return False


def nth_matches(a: int, b: int, n: int) -> bool:
    return n == b if a == 0 else (n - b) % a == 0 and (n - b) // a >= 0


def attr_matches(op: str, actual: str, wanted: str, no_case: bool) -> bool:
    if no_case:
        actual, wanted = ascii_lower(actual), ascii_lower(wanted)
    if op == "=":
        return actual == wanted
    if op == "~=":
        return bool(wanted) and not _BLANK.search(wanted) and wanted in _BLANK.split(actual)
    if op == "|=":
        return actual == wanted or actual.startswith(wanted + "-")
    return bool(wanted) and {"^=": actual.startswith, "$=": actual.endswith, "*=": actual.__contains__}[op](wanted)


def _same_type(x, n) -> bool:
    return x.name == n.name and (x.ns == "html") == (n.ns == "html")


def _simple(s: tuple, n, ix: Index) -> bool:
    kind = s[0]
    if kind == "*":
        return True
    if kind == "type":
        return n.name == ascii_lower(s[1]) if n.ns == "html" and n.name.islower() else ascii_lower(n.name) == ascii_lower(s[1]) if n.ns == "html" else n.name == s[1]
    if kind == "class":
        c = n.get("class")
        return c is not None and s[1] in _BLANK.split(c)
    if kind == "id":
        return n.get("id") == s[1]
    if kind == "attr":
        name = ascii_lower(s[1]) if n.ns == "html" else s[1]
        actual = n.get(name)
        if actual is None:
            return False
        return s[2] is None or attr_matches(s[2], actual, s[3], s[4] == "i" if s[4] else n.ns == "html" and name in NO_CASE)
    if kind in ("is", "where"):
        return matches_list(s[1], n, ix)
    if kind == "not":
        return not matches_list(s[1], n, ix)
    if kind == "state":
        return _state(s[1], n, ix)
    if kind == "nth":
        _, a, b, from_end, of_type, only = s
        if only is not None and not matches_list(only, n, ix):
            return False
        row, i = ix.place(n)
        others = row[i + 1 :] if from_end else row[:i]
        if only is not None:
            others = [x for x in others if matches_list(only, x, ix)]
        elif of_type:
            others = [x for x in others if _same_type(x, n)]
        return nth_matches(a, b, len(others) + 1)
    return False


def _state(name: str, n, ix: Index) -> bool:
    if name == "root":
        return n.parent is not None and n.parent.kind == "document"
    if name == "empty":
        return not any(k.kind in ("element", "text") for k in n.kids)
    row, i = ix.place(n)
    before, after = row[:i], row[i + 1 :]
    if name.endswith("of-type"):
        before, after = ([x for x in r if _same_type(x, n)] for r in (before, after))
    return (name[0] == "l" or not before) and (name[0] == "f" or not after)
