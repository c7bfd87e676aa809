"""The cascade as joins and aggregates: rule candidates by key, priorities, winners, keywords, inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels.css_values import INHERITED, PROPERTIES, PX, RELATIVE, format_value, initial_value


def rule_candidates(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, node_id, rule columns) where a rule's subject key (key_kind, key) stands on an element: an equality join on exploded keys."""
    e = nodes.where("kind = 'element'")
    keys = F.concat(
        F.array(F.struct(F.lit("universal").alias("k"), F.lit("").alias("v")), F.struct(F.lit("tag").alias("k"), F.col("name_lc").alias("v"))),
        F.when(F.col("id").isNotNull(), F.array(F.struct(F.lit("id").alias("k"), F.col("id").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>")),
        F.transform(F.array_distinct("classes"), lambda c: F.struct(F.lit("class").alias("k"), c.alias("v"))),
    )
    exploded = e.select("page_id", "node_id", F.explode(keys).alias("_k")).select("page_id", "node_id", F.col("_k.k").alias("key_kind"), F.col("_k.v").alias("key"))
    return exploded.join(rules, ["key_kind", "key"])


def best_specificity(matched: DataFrame) -> DataFrame:
    """One row for each (page_id, node_id, rule): several selectors of a rule that fit count once, at the highest specificity."""
    return matched.groupBy("page_id", "node_id", "rule").agg(F.max(F.struct("a", "b", "c")).alias("spec")).select("page_id", "node_id", "rule", "spec.a", "spec.b", "spec.c")


def priority(author: Column, important: Column, inner: Column, inline: Column, spec: Column, rule: Column, decl: Column) -> Column:
    """What orders declarations: origin with importance, tree (rules of the host's inner tree are weaker, or stronger if important), style attribute, specificity, order."""
    level = F.when(author & important, 2).when(important, 3).when(author, 1).otherwise(0)
    tree = (inner == important).cast("int")
    return F.struct(level.alias("level"), tree.alias("tree"), inline.alias("inline"), spec.alias("spec"), rule.alias("rule"), decl.alias("decl"))


def winners(declared: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The value of highest priority for each of keys; partial maxima come before the shuffle."""
    return declared.groupBy(*keys).agg(F.max_by(value, "priority").alias(value))


def properties(spark: SparkSession) -> DataFrame:
    """property, initial, inherited: 39 rows."""
    return spark.createDataFrame([(p, format_value(initial_value(p)), p in INHERITED) for p in PROPERTIES], "property string, initial string, inherited boolean")


def resolve_keywords(won: DataFrame, parents: DataFrame) -> DataFrame:
    """won (node_id, property, value) with CSS-wide keywords and gaps filled from parents (node_id, property, parent_value) and initial values.

    revert and revert-layer count as unset; no declaration is unset too."""
    spark = won.sparkSession
    every = parents.join(F.broadcast(properties(spark)), "property").join(won, ["node_id", "property"], "left")
    unset = F.when(F.col("inherited"), F.col("parent_value")).otherwise(F.col("initial"))
    v = F.col("value")
    out = F.when(v.isNull() | v.isin("unset", "revert", "revert-layer"), unset).when(v == "inherit", F.col("parent_value")).when(v == "initial", F.col("initial")).otherwise(v)
    return every.select("node_id", "property", out.alias("value"))


def inherit_nearest(nodes: DataFrame, declared: DataFrame, initial: str) -> DataFrame:
    """(page_id, node_id, value) of an inherited keyword property: that of the nearest ancestor-or-self that declares it (declared: page_id, node_id, value), else initial."""
    up = nodes.select("page_id", "node_id", F.posexplode(F.concat("path", F.array("node_id"))).alias("depth", "up"))
    d = declared.select("page_id", F.col("node_id").alias("up"), "value")
    near = up.join(d, ["page_id", "up"]).groupBy("page_id", "node_id").agg(F.max_by("value", "depth").alias("value"))
    return nodes.select("page_id", "node_id").join(near, ["page_id", "node_id"], "left").select("page_id", "node_id", F.coalesce("value", F.lit(initial)).alias("value"))


def relative_weight(parent: Column, word: Column) -> Column:
    """Computed font-weight of a keyword or number under a parent's weight."""
    bolder = F.when(parent < 350, 400.0).when(parent < 550, 700.0).otherwise(F.greatest(parent, F.lit(900.0)))
    lighter = F.when(parent < 100, parent).when(parent < 550, 100.0).when(parent < 750, 400.0).otherwise(700.0)
    return F.when(word == "bolder", bolder).when(word == "lighter", lighter).when(word == "bold", 700.0).when(word == "normal", 400.0).when(word.isNull(), parent).otherwise(word.try_cast("double"))


def units(spark: SparkSession) -> DataFrame:
    """unit, px: absolute units with their pixels, others with null."""
    return spark.createDataFrame([(u, PX.get(u)) for u in [*PX, *sorted(RELATIVE)]], "unit string, px double")


def length_px(value: Column, unit: Column, em: Column, root: Column, width: Column, height: Column) -> Column:
    """Pixels of a length; ex, ch and cap are half an em, lh is 1.2 em."""
    out = F.when(unit.isin("em", "ic"), em).when(unit.isin("ex", "ch", "cap"), em / 2).when(unit == "lh", em * 1.2)
    out = out.when(unit == "rem", root).when(unit.isin("rex", "rch"), root / 2).when(unit == "rlh", root * 1.2)
    out = out.when(unit.isin("vw", "svw", "lvw", "dvw", "vi"), width / 100).when(unit.isin("vh", "svh", "lvh", "dvh", "vb"), height / 100)
    out = out.when(unit == "vmin", F.least(width, height) / 100).when(unit == "vmax", F.greatest(width, height) / 100)
    for u, px in PX.items():
        out = out.when(unit == u, px)
    return value * out


def border_width(px: Column, style: Column, resolution: Column) -> Column:
    """Used border width: none without a style, else cut to device pixels, one at least."""
    return F.when(style.isin("none", "hidden") | (px <= 0), 0.0).otherwise(F.greatest(F.floor(px * resolution), F.lit(1)) / resolution)


def overflow_pair(x: Column, y: Column) -> tuple[Column, Column]:
    """visible or clip on one axis alone becomes auto or hidden."""
    soft = lambda c: c.isin("visible", "clip")
    fix = lambda c: F.when(soft(x) != soft(y), F.when(c == "visible", "auto").when(c == "clip", "hidden").otherwise(c)).otherwise(c)
    return fix(x), fix(y)


def blockify(display: Column) -> Column:
    """Display of what floats, is positioned, is the root or stands in a flex or grid container."""
    return (
        F.when(display == "inline-flex", "flex")
        .when(display == "inline-grid", "grid")
        .when(display == "inline-table", "table")
        .when(display == "math", "block math")
        .when(display.isin("inline", "inline-block", "ruby", "ruby-text") | (display.startswith("table-")), "block")
        .otherwise(display)
    )


def assign_slots(nodes: DataFrame) -> DataFrame:
    """(page_id, host_id, slot_id, node_id): children of shadow hosts under the first slot of their name; texts have the empty name."""
    from pyspark.sql.window import Window

    shadows = nodes.where("kind = 'shadow'").select("page_id", F.col("node_id").alias("tree_root"), F.col("host_id").alias("_host"))
    slots = nodes.where("kind = 'element' AND ns = 'html' AND name = 'slot'").join(shadows, ["page_id", "tree_root"])
    slots = slots.select("page_id", F.col("_host").alias("host_id"), F.coalesce(F.element_at("attrs", "name"), F.lit("")).alias("slot"), F.col("node_id").alias("slot_id"))
    w = Window.partitionBy("page_id", "host_id", "slot").orderBy("slot_id")
    slots = slots.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    kids = nodes.where("kind IN ('element', 'text') AND parent_id IS NOT NULL")
    name = F.when(F.col("kind") == "element", F.coalesce(F.element_at("attrs", "slot"), F.lit(""))).otherwise(F.lit(""))
    kids = kids.select("page_id", F.col("parent_id").alias("host_id"), name.alias("slot"), "node_id")
    return kids.join(slots, ["page_id", "host_id", "slot"]).select("page_id", "host_id", "slot_id", "node_id")


def flat_edges(nodes: DataFrame) -> DataFrame:
    """(page_id, parent_id, child_id, ord) of the flat tree: a host's children are its shadow tree's, a slot's what is assigned to it, if anything is."""
    given = assign_slots(nodes)
    shadows = nodes.where("kind = 'shadow'").select("page_id", F.col("node_id").alias("parent_id"), "host_id")
    base = nodes.where("parent_id IS NOT NULL").select("page_id", "parent_id", "node_id", "child_idx")
    hosts = shadows.select("page_id", F.col("host_id").alias("parent_id"))
    filled = given.select("page_id", F.col("slot_id").alias("parent_id")).distinct()
    plain = base.join(hosts, ["page_id", "parent_id"], "left_anti").join(filled, ["page_id", "parent_id"], "left_anti").join(shadows.select("page_id", "parent_id"), ["page_id", "parent_id"], "left_anti")
    inner = base.join(shadows, ["page_id", "parent_id"]).select("page_id", F.col("host_id").alias("parent_id"), "node_id", "child_idx")
    slotted = given.join(base.select("page_id", "node_id", "child_idx"), ["page_id", "node_id"]).select("page_id", F.col("slot_id").alias("parent_id"), "node_id", "child_idx")
    return plain.unionByName(inner).unionByName(slotted).select("page_id", "parent_id", F.col("node_id").alias("child_id"), F.col("child_idx").alias("ord"))
