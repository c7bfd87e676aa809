"""Media queries and @supports conditions."""

from __future__ import annotations

from dataclasses import dataclass, field

from .css_selectors import parse_selector_list
from .css_syntax import Token, no_space, parse_values, preprocess, split_commas, to_css
from .css_values import PX, PROPERTIES, SHORTHANDS, format_number, format_value, is_custom, length, parse_property

# The features with their type, keyword lists with the value that counts as false, and lists whose order counts.
TYPES = dict.fromkeys(("width", "height", "device-width", "device-height"), "length") | {
    "aspect-ratio": "ratio",
    "device-aspect-ratio": "ratio",
    "resolution": "resolution",
    "color": "integer",
    "color-index": "integer",
    "monochrome": "integer",
    "-webkit-device-pixel-ratio": "number",
    "grid": "grid",
}
WORDS: dict[str, tuple[tuple[str, ...], str | None]] = {
    "orientation": (("portrait", "landscape"), None),
    "hover": (("none", "hover"), "none"),
    "any-hover": (("none", "hover"), "none"),
    "pointer": (("none", "coarse", "fine"), "none"),
    "any-pointer": (("none", "coarse", "fine"), "none"),
    "prefers-color-scheme": (("light", "dark"), None),
    "prefers-reduced-motion": (("no-preference", "reduce"), "no-preference"),
    "prefers-reduced-transparency": (("no-preference", "reduce"), "no-preference"),
    "prefers-contrast": (("no-preference", "less", "more", "custom"), "no-preference"),
    "forced-colors": (("none", "active"), "none"),
    "scripting": (("none", "initial-only", "enabled"), "none"),
    "update": (("none", "slow", "fast"), "none"),
    "overflow-block": (("none", "scroll", "paged"), "none"),
    "overflow-inline": (("none", "scroll"), "none"),
    "color-gamut": (("srgb", "p3", "rec2020"), None),
    "dynamic-range": (("standard", "high"), None),
    "video-dynamic-range": (("standard", "high"), None),
    "display-mode": (("browser", "fullscreen", "standalone", "minimal-ui", "picture-in-picture", "window-controls-overlay"), None),
}
ORDERED = ("color-gamut", "dynamic-range", "video-dynamic-range")
DESKTOP = {
    "hover": "hover",
    "any-hover": "hover",
    "pointer": "fine",
    "any-pointer": "fine",
    "prefers-color-scheme": "light",
    "scripting": "enabled",
    "update": "fast",
    "overflow-block": "scroll",
    "overflow-inline": "scroll",
    "color-gamut": "srgb",
    "dynamic-range": "standard",
    "video-dynamic-range": "standard",
    "display-mode": "browser",
}


@dataclass
class Environment:
    media_type: str = "screen"
    width: float = 1024.0
    height: float = 768.0
    device_width: float = 1024.0
    device_height: float = 768.0
    resolution: float = 1.0
    color: int = 8
    font_size: float = 16.0
    features: dict[str, str] = field(default_factory=lambda: dict(DESKTOP))


# A query is None (invalid) or (qualifier, type, condition). A condition is ("not", x), ("and", xs) or ("or", xs);
# x is ("cond", condition), ("unknown", text), ("bool", name), ("plain", name, feature, prefix, value)
# or ("range", feature, value, op, op, value). A value is a length of css_values, ("num", n), ("ratio", a, b), ("res", n, unit) or ("kw", word).


def parse_media(text: str) -> list:
    vals = parse_values(preprocess(text))
    return [] if not no_space(vals) else [_query(no_space(p)) for p in split_commas(vals)]


def _word(t: Token) -> str:
    return t.value.lower() if t.kind == "ident" else ""


def _query(toks: list[Token]):
    if not toks:
        return None
    c = _condition(toks, True)
    if c:
        return None, None, c
    qualifier = _word(toks[0]) if _word(toks[0]) in ("not", "only") else None
    rest = toks[1:] if qualifier else toks
    kind = _word(rest[0]) if rest else ""
    if not kind or kind in ("only", "not", "and", "or", "layer"):
        return None
    if len(rest) == 1:
        return qualifier, kind, None
    c = _condition(rest[2:], False) if _word(rest[1]) == "and" else None
    return (qualifier, kind, c) if c else None


def _condition(toks: list[Token], either: bool):
    if not toks:
        return None
    if _word(toks[0]) == "not":
        x = _parens(toks[1]) if len(toks) == 2 else None
        return x and ("not", x)
    items = [_parens(t) for t in toks[::2]]
    joins = {_word(t) for t in toks[1::2]}
    if None in items or len(toks) % 2 == 0 or len(joins) > 1 or not joins <= ({"and", "or"} if either else {"and"}):
        return None
    return ("or" if "or" in joins else "and"), items


def _parens(t: Token):
    if t.kind == "function":
        return "unknown", to_css([t])
    if t.kind != "block" or t.value != "(":
        return None
    c = _condition(no_space(t.kids), True)
    if c:
        return "cond", c
    return _feature(t.kids) or ("unknown", to_css([t]))


def _feature(kids: list[Token]):
    items, loose = [], False
    for t in kids:
        if t.kind == "ws":
            loose = True
        else:
            items.append((t, loose))
            loose = False
    if len(items) == 1:
        name = _word(items[0][0])
        return ("bool", name) if name in TYPES or name in WORDS else None
    if len(items) >= 2 and _word(items[0][0]) and items[1][0].kind == ":":
        name = _word(items[0][0])
        for mark in ("min-", "max-"):
            base = name[4:] if name.startswith(mark) else f"-webkit-{name[12:]}" if name.startswith(f"-webkit-{mark}") else None
            if base and (base in TYPES or base in WORDS):
                if base in WORDS or base == "grid":
                    return None
                v = _value(base, [i[0] for i in items[2:]])
                return v and ("plain", name, base, mark[:3], v)
        v = _value(name, [i[0] for i in items[2:]])
        return v and ("plain", name, name, None, v)
    return _range(items)


def _range(items: list):
    parts: list[list[Token]] = [[]]
    ops: list[str] = []
    i = 0
    while i < len(items):
        t = items[i][0]
        if t.kind == "delim" and t.value in "<>=":
            op = t.value
            if op != "=" and i + 1 < len(items) and items[i + 1][0].is_delim("=") and not items[i + 1][1]:
                op += "="
                i += 1
            ops.append(op)
            parts.append([])
        else:
            parts[-1].append(t)
        i += 1
    if not all(parts):
        return None
    ranged = lambda p: (_word(p[0]) if len(p) == 1 and _word(p[0]) in TYPES and TYPES[_word(p[0])] not in ("number", "grid") else None)
    if len(ops) == 1:
        name = ranged(parts[0])
        v = _value(name or ranged(parts[1]), parts[1] if name else parts[0])
        if not v:
            return None
        return ("range", name, None, None, ops[0], v) if name else ("range", ranged(parts[1]), v, ops[0], None, None)
    if len(ops) == 2 and ops[0][0] == ops[1][0] != "=":
        name = ranged(parts[1])
        a, b = _value(name, parts[0]), _value(name, parts[2])
        return a and b and ("range", name, a, ops[0], ops[1], b)
    return None


def _number(t: Token) -> float | None:
    return t.num if t.kind == "number" and t.num >= 0 else None


def _value(name: str | None, toks: list[Token]):
    one = toks[0] if len(toks) == 1 else None
    if name in WORDS:
        return ("kw", _word(one)) if one and _word(one) in WORDS[name][0] else None
    kind = TYPES.get(name or "")
    if kind == "ratio":
        if len(toks) not in (1, 3) or (len(toks) == 3 and not toks[1].is_delim("/")):
            return None
        a, b = _number(toks[0]), _number(toks[2]) if len(toks) == 3 else 1.0
        return None if a is None or b is None else ("ratio", a, b)
    if one is None or kind is None:
        return None
    if kind == "length":
        return ("num", 0.0) if one.kind == "number" and one.num == 0 else length(one, False, True)
    if kind == "resolution":
        return ("res", one.num, one.unit.lower()) if one.kind == "dimension" and one.num >= 0 and one.unit.lower() in ("dppx", "x", "dpi", "dpcm") else None
    if _number(one) is None or (kind != "number" and not one.integer) or (kind == "grid" and one.num > 1):
        return None
    return "num", one.num


# evaluating: None is unknown


def _all(xs) -> bool | None:
    xs = list(xs)
    return False if False in xs else None if None in xs else True


def _any(xs) -> bool | None:
    xs = list(xs)
    return True if True in xs else None if None in xs else False


def media_matches(queries: list, env: Environment) -> bool:
    return not queries or any(q is not None and query_matches(q, env) for q in queries)


def query_matches(q, env: Environment) -> bool:
    qualifier, kind, c = q
    got = _all([kind in (None, "all", env.media_type), True if c is None else condition_matches(c, env)])
    return (got if qualifier != "not" or got is None else not got) or False


def condition_matches(c, env: Environment) -> bool | None:
    if c[0] == "not":
        got = _holds(c[1], env)
        return None if got is None else not got
    return (_all if c[0] == "and" else _any)(_holds(x, env) for x in c[1])


def _holds(x, env: Environment) -> bool | None:
    k = x[0]
    if k == "cond":
        return condition_matches(x[1], env)
    if k == "unknown":
        return None
    if k == "bool":
        if x[1] in WORDS:
            false = WORDS[x[1]][1]
            now = _now_word(x[1], env)
            return false is None or (now is not None and now != false)
        return bool(_now(x[1], env))
    if k == "plain":
        _, _, feature, prefix, v = x
        if v[0] == "kw":
            now = _now_word(feature, env)
            if feature in ORDERED:
                order = WORDS[feature][0]
                return now in order and order.index(v[1]) <= order.index(now)
            return now == v[1]
        return _compare(_now(feature, env), {"min": ">=", "max": "<=", None: "="}[prefix], _size(v, env))
    _, feature, left, op1, op2, right = x
    now = _now(feature, env)
    return (left is None or _compare(_size(left, env), op1, now)) and (right is None or _compare(now, op2, _size(right, env)))


def _compare(a: float | None, op: str, b: float | None) -> bool:
    """Equal is equal to a millionth."""
    if a is None or b is None:
        return False
    same = abs(a - b) <= 1e-6 * max(abs(a), abs(b), 1.0)
    return same if op == "=" else (op[-1] == "=") if same else (a < b if op[0] == "<" else a > b)


def _now(feature: str, env: Environment) -> float | None:
    if feature in ("resolution", "-webkit-device-pixel-ratio"):
        return env.resolution
    if feature in ("aspect-ratio", "device-aspect-ratio"):
        w, h = (env.width, env.height) if feature == "aspect-ratio" else (env.device_width, env.device_height)
        return w / h if h else float("inf")
    if feature in ("color-index", "monochrome", "grid"):
        return 0.0
    return float(getattr(env, feature.replace("-", "_")))


def _now_word(feature: str, env: Environment) -> str | None:
    if feature == "orientation":
        return "portrait" if env.height >= env.width else "landscape"
    return env.features.get(feature)


def length_px(v: float, unit: str, env: Environment) -> float:
    if unit in PX:
        return v * PX[unit]
    w, h, em = env.width / 100, env.height / 100, env.font_size
    if unit in ("em", "rem", "ic"):
        return v * em
    if unit in ("ex", "rex", "ch", "rch", "cap"):
        return v * em / 2
    if unit in ("lh", "rlh"):
        return v * em * 1.2
    if unit in ("vmin", "vmax"):
        return v * (min if unit == "vmin" else max)(w, h)
    return v * (w if unit in ("vw", "svw", "lvw", "dvw", "vi") else h)


def _size(v: tuple, env: Environment) -> float | None:
    if v[0] == "num":
        return v[1]
    if v[0] == "len":
        return length_px(v[1], v[2], env)
    if v[0] == "calc":
        return sum(length_px(x, u, env) for u, x in v[1].items())
    if v[0] == "ratio":
        return v[1] / v[2] if v[2] else (float("inf") if v[1] else float("nan"))
    if v[0] == "res":
        return v[1] * {"dpi": 1 / 96, "dpcm": 2.54 / 96}.get(v[2], 1.0)
    return None


# serialising


def format_media(queries: list) -> str:
    return ", ".join("not all" if q is None else _format_query(q) for q in queries)


def _format_query(q) -> str:
    qualifier, kind, c = q
    parts = [qualifier] if qualifier else []
    if kind and not (kind == "all" and not qualifier and c):
        parts.append(kind)
    if c:
        parts += (["and"] if parts else []) + [_format_condition(c)]
    return " ".join(parts)


def _format_condition(c) -> str:
    return f"not {_format_item(c[1])}" if c[0] == "not" else f" {c[0]} ".join(map(_format_item, c[1]))


def _format_item(x) -> str:
    if x[0] == "cond":
        return f"({_format_condition(x[1])})"
    if x[0] == "unknown":
        return x[1]
    if x[0] == "bool":
        return f"({x[1]})"
    if x[0] == "plain":
        return f"({x[1]}: {_format_value(x[4])})"
    _, feature, left, op1, op2, right = x
    return "(" + (f"{_format_value(left)} {op1} " if left else "") + feature + (f" {op2} {_format_value(right)}" if right else "") + ")"


def _format_value(v: tuple) -> str:
    if v[0] == "ratio":
        return f"{format_number(v[1])} / {format_number(v[2])}"
    return format_number(v[1]) + v[2] if v[0] == "res" else format_value(v)


# @supports


def supports(text: str) -> bool:
    """Whether a condition holds. A property that isn't known counts as supported, unless it has another engine's prefix."""
    return _supports(no_space(parse_values(text))) or False


def _supports(toks: list[Token]) -> bool | None:
    if not toks:
        return None
    if _word(toks[0]) == "not":
        got = _supports_item(toks[1]) if len(toks) == 2 else None
        return None if got is None else not got
    items = [_supports_item(t) for t in toks[::2]]
    joins = {_word(t) for t in toks[1::2]}
    if None in items or len(toks) % 2 == 0 or len(joins) > 1 or not joins <= {"and", "or"}:
        return None
    return any(items) if "or" in joins else all(items)


def _supports_item(t: Token) -> bool | None:
    if t.kind == "function":
        return parse_selector_list(t.kids) is not None if t.value.lower() == "selector" else False
    if t.kind != "block" or t.value != "(":
        return None
    got = _supports(no_space(t.kids))
    if got is not None:
        return got
    solid = no_space(t.kids)
    if len(solid) < 2 or solid[0].kind != "ident" or solid[1].kind != ":":
        return False
    name = solid[0].value.lower()
    if is_custom(name):
        return True
    if name.startswith(("-moz-", "-ms-", "-o-")):
        return False
    return parse_property(name, solid[2:]) is not None if name in PROPERTIES or name in SHORTHANDS else True
