"""Media queries against rows of environments, with SQL's own logic of three values: null is unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels.css_media import ORDERED, WORDS, Environment, format_media, media_matches, parse_media, supports
from ..kernels.css_values import PX
from ..session import flat_map

ENVIRONMENT = "env_id long, media_type string, width double, height double, device_width double, device_height double, resolution double, color int, font_size double, features map<string,string>"


def compare(a: Column, op: str, b: Column) -> Column:
    """Comparison where values within a millionth are equal."""
    same = F.abs(a - b) <= F.lit(1e-6) * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    if op == "=":
        return same
    strict = (a < b) if op[0] == "<" else (a > b)
    return strict | same if op.endswith("=") else strict & ~same


def _now(feature: str) -> Column:
    if feature in ("resolution", "-webkit-device-pixel-ratio"):
        return F.col("resolution")
    if feature == "aspect-ratio":
        return F.col("width") / F.col("height")
    if feature == "device-aspect-ratio":
        return F.col("device_width") / F.col("device_height")
    if feature in ("color-index", "monochrome", "grid"):
        return F.lit(0.0)
    return F.col(feature.replace("-", "_")).cast("double")


def _word(feature: str) -> Column:
    if feature == "orientation":
        return F.when(F.col("height") >= F.col("width"), "portrait").otherwise("landscape")
    return F.element_at("features", feature)


def _length(v: float, unit: str) -> Column:
    if unit in PX:
        return F.lit(v * PX[unit])
    w, h, em = F.col("width") / 100, F.col("height") / 100, F.col("font_size")
    by = {"em": em, "rem": em, "ic": em, "ex": em / 2, "rex": em / 2, "ch": em / 2, "rch": em / 2, "cap": em / 2, "lh": em * 1.2, "rlh": em * 1.2, "vmin": F.least(w, h), "vmax": F.greatest(w, h)}
    return F.lit(v) * (by[unit] if unit in by else h if unit.endswith(("vh", "vb")) else w)


def _size(v: tuple) -> Column:
    if v[0] == "num":
        return F.lit(v[1])
    if v[0] == "len":
        return _length(v[1], v[2])
    if v[0] == "calc":
        return reduce(lambda a, b: a + b, (_length(x, u) for u, x in v[1].items()), F.lit(0.0))
    if v[0] == "ratio":
        return F.lit(v[1] / v[2] if v[2] else float("inf"))
    return F.lit(v[1] * {"dpi": 1 / 96, "dpcm": 2.54 / 96}.get(v[2], 1.0))


def _holds(x) -> Column:
    kind = x[0]
    if kind == "cond":
        return _condition(x[1])
    if kind == "unknown":
        return F.lit(None).cast("boolean")
    if kind == "bool":
        if x[1] in WORDS:
            false = WORDS[x[1]][1]
            return F.lit(True) if false is None else F.coalesce(_word(x[1]) != false, F.lit(False))
        return _now(x[1]) != 0
    if kind == "plain":
        _, _, feature, prefix, v = x
        if v[0] == "kw":
            if feature in ORDERED:
                order = F.array(*map(F.lit, WORDS[feature][0]))
                return F.coalesce(F.array_position(order, _word(feature)) >= WORDS[feature][0].index(v[1]) + 1, F.lit(False))
            return F.coalesce(_word(feature) == v[1], F.lit(False))
        return F.coalesce(compare(_now(feature), {"min": ">=", "max": "<=", None: "="}[prefix], _size(v)), F.lit(False))
    _, feature, left, op1, op2, right = x
    out = F.lit(True)
    if left is not None:
        out = out & compare(_size(left), op1, _now(feature))
    if right is not None:
        out = out & compare(_now(feature), op2, _size(right))
    return F.coalesce(out, F.lit(False))


def _condition(c) -> Column:
    if c[0] == "not":
        return ~_holds(c[1])
    return reduce(lambda a, b: (a & b) if c[0] == "and" else (a | b), map(_holds, c[1]))


def media_column(text: str) -> Column:
    """A media query list as a predicate on a row of environments; unknown counts as false at the top."""
    queries = parse_media(text)
    if not queries:
        return F.lit(True)
    out = F.lit(False)
    for q in queries:
        if q is None:
            continue
        qualifier, kind, c = q
        got = F.lit(True) if kind in (None, "all") else F.col("media_type") == kind
        got = got if c is None else got & _condition(c)
        out = out | F.coalesce(~got if qualifier == "not" else got, F.lit(False))
    return out


def match_media(environments: DataFrame, queries: list[str]) -> DataFrame:
    """(env_id, case_id, matches) of each query in each environment, by native predicates."""
    one = F.array(*[F.struct(F.lit(i).cast("long").alias("case_id"), media_column(q).alias("matches")) for i, q in enumerate(queries)])
    return environments.select("env_id", F.explode(one).alias("m")).select("env_id", "m.case_id", "m.matches")


def media_by_kernel(cases: DataFrame, env: Environment) -> DataFrame:
    """(case_id, media, matches) of case_id, query: the serialised list, and whether it matches."""

    def kernel(case_id: int, query: str):
        q = parse_media(query)
        yield case_id, format_media(q), media_matches(q, env)

    return flat_map(cases.select("case_id", "query"), kernel, "case_id long, media string, matches boolean")


def supports_by_kernel(cases: DataFrame) -> DataFrame:
    """(case_id, supported) of case_id, condition."""
    return flat_map(cases.select("case_id", "condition"), lambda i, c: [(i, supports(c))], "case_id long, supported boolean")
