"""DOM navigation as relational algebra over the table of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["page_id", "node_id"]


def elements(nodes: DataFrame, name: str | None = None) -> DataFrame:
    """Elements of the document tree, of one name if given."""
    out = nodes.where((F.col("kind") == "element") & (F.col("tree_root") == 0))
    return out if name is None else out.where(F.col("name") == name)


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """Children of parents (page_id, node_id); their order is child_idx."""
    p = parents.select("page_id", F.col("node_id").alias("parent_id")).distinct()
    return nodes.join(p, ["page_id", "parent_id"], "left_semi").select(*nodes.columns)


def descendants(nodes: DataFrame, roots: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(root_id, node) for every node below roots (page_id, node_id) in the same tree: equal ids on the exploded path, no range join."""
    wanted = columns or nodes.columns
    r = roots.select("page_id", F.col("node_id").alias("root_id")).distinct()
    below = nodes.select(*dict.fromkeys(["page_id", *wanted]), F.explode("path").alias("root_id"))
    return below.join(r, ["page_id", "root_id"]).select("root_id", *wanted)


def relatives(nodes: DataFrame) -> DataFrame:
    """page_id, node_id and its parent, first and last child, previous and next sibling (null where there is none)."""
    w = Window.partitionBy("page_id", "parent_id").orderBy("child_idx")
    inner = nodes.where("parent_id IS NOT NULL")
    ends = inner.groupBy("page_id", F.col("parent_id").alias("node_id")).agg(F.min_by("node_id", "child_idx").alias("first_child"), F.max_by("node_id", "child_idx").alias("last_child"))
    side = inner.select("page_id", "node_id", "parent_id", F.lag("node_id").over(w).alias("prev_sibling"), F.lead("node_id").over(w).alias("next_sibling"))
    tops = nodes.where("parent_id IS NULL").select("page_id", "node_id", "parent_id", F.lit(None).cast("int").alias("prev_sibling"), F.lit(None).cast("int").alias("next_sibling"))
    return side.unionByName(tops).join(ends, KEY, "left")


def text_content(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """page_id, node_id, text of all text below each root, in document order."""
    texts = descendants(nodes.where("kind = 'text'"), roots, ["page_id", "node_id", "text"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "")
    found = texts.groupBy("page_id", "root_id").agg(joined.alias("text")).withColumnRenamed("root_id", "node_id")
    return roots.select(*KEY).distinct().join(found, KEY, "left").select(*KEY, F.coalesce("text", F.lit("")).alias("text"))


def clone_subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Copies of the trees at roots: root_id and the rows below it and itself, numbered from 0 at the root, without the shadow roots' trees."""
    r = roots.select("page_id", F.col("node_id").alias("root_id")).distinct()
    all_ = nodes.withColumn("root_id", F.explode(F.concat("path", F.array("node_id")))).join(r, ["page_id", "root_id"])
    w = Window.partitionBy("page_id", "root_id").orderBy("node_id")
    numbered = all_.withColumn("copy_id", (F.row_number().over(w) - 1).cast("int"))
    up = numbered.select("page_id", "root_id", F.col("node_id").alias("parent_id"), F.col("copy_id").alias("copy_parent"))
    return numbered.join(up, ["page_id", "root_id", "parent_id"], "left").select("page_id", "root_id", "copy_id", "copy_parent", "kind", "name", "text", "attrs")


def reparent(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """parent_id of each node after moves (page_id, from_id, to_id) of all children of one node to another: page_id, node_id, parent_id, child_idx."""
    base = nodes.select("page_id", "node_id", "parent_id", "child_idx")
    m = moves.select("page_id", F.col("from_id").alias("parent_id"), "to_id")
    moved = base.join(m, ["page_id", "parent_id"], "left").withColumn("new_parent", F.coalesce("to_id", "parent_id"))
    w = Window.partitionBy("page_id", "new_parent").orderBy(F.col("to_id").isNotNull(), "child_idx", "node_id")
    return moved.select("page_id", "node_id", F.col("new_parent").alias("parent_id"), (F.row_number().over(w) - 1).cast("int").alias("child_idx"))


def structure(nodes: DataFrame) -> DataFrame:
    """Places of elements among their siblings, by windows: the same columns as the kernel gives."""
    w = Window.partitionBy("page_id", "parent_id")
    kind = [*["page_id", "parent_id", "name"], F.col("ns") == "html"]
    e = nodes.where("kind = 'element'")
    number = lambda part: F.row_number().over(part.orderBy("child_idx")).cast("int")
    count = lambda part: F.count("*").over(part).cast("int")
    t = Window.partitionBy(*kind)
    return e.select(*KEY, number(w).alias("elem_idx"), count(w).alias("elem_count"), number(t).alias("type_idx"), count(t).alias("type_count"))


def nth_matches(a: int, b: int, index: Column) -> Column:
    """Whether index is a*k + b for some k >= 0."""
    if a == 0:
        return index == b
    return ((index - b) % a == 0) & ((index - b) / a >= 0)


def dump(nodes: DataFrame) -> DataFrame:
    """page_id, dump: the document tree as indented lines, attributes by name."""
    pad = lambda extra: F.concat(F.lit("| "), F.repeat(F.lit("  "), F.col("depth") - 1 + extra))
    prefix = F.when(F.col("ns") == "svg", "svg ").when(F.col("ns") == "mathml", "math ").otherwise("")
    named = F.transform("attr_list", lambda a: F.struct(F.when(a["ns"] == "", a["name"]).otherwise(F.concat(a["ns"], F.lit(" "), a["name"])).alias("n"), a["value"].alias("v")))
    attrs = F.array_join(F.transform(F.sort_array(named), lambda a: F.concat(F.lit("\n"), pad(1), a["n"], F.lit('="'), a["v"], F.lit('"'))), "")
    line = (
        F.when(F.col("kind") == "element", F.concat(pad(0), F.lit("<"), prefix, F.col("name"), F.lit(">"), attrs))
        .when(F.col("kind") == "text", F.concat(pad(0), F.lit('"'), F.col("text"), F.lit('"')))
        .when(F.col("kind") == "comment", F.concat(pad(0), F.lit("<!-- "), F.col("text"), F.lit(" -->")))
        .when(F.col("kind") == "pi", F.concat(pad(0), F.lit("<?"), F.col("name"), F.lit(" "), F.col("text"), F.lit("?>")))
        .otherwise(F.concat(pad(0), F.lit("<!DOCTYPE "), F.col("name"), F.lit(">")))
    )
    rows = nodes.where("tree_root = 0 AND kind != 'document'").select("page_id", "node_id", line.alias("line"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node_id", "line"))), lambda x: x["line"]), "\n").alias("dump"))
