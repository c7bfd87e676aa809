"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, discard, ship

THRESHOLD = 0.93
#: Neighbours that each vector is compared with in a pass, random hashes of a pass, and the share of pairs at the threshold
#: that the passes of a label are to find, if its vectors lie at random (pairs above it are found sooner).
WINDOW, HASHES, RECALL, SEED = 512, 64, 0.999, 7
#: Passes of one job; rows of one task, about; partitions whose edges meet in one group.
PASSES_AT_ONCE, ROWS_A_TASK, EDGES_AT_ONCE = 3, 1 << 15, 32
#: Vectors of one task when links are counted; a larger component is compared block by block. Products held at once.
BLOCK, TILE = 2048, 1 << 20
#: Cosines this near to the threshold are added up anew, component by component in one order, so that all stages agree on them.
CLOSE = 1e-9


def passes_for(size: Column, threshold: float, window: int, recall: float) -> Column:
    """Passes of a label of `size` classes: one where a window holds them all.

    Two vectors at the threshold agree in a random hash with probability q = 1 - angle / pi, so their first l hashes agree with
    q ** l, and then they stand among size / 2 ** l others: a pass finds the pair with (window / size) ** -log2(q) or more."""
    power = -math.log2(1 - math.acos(threshold) / math.pi)
    hit = F.pow(F.lit(float(window)) / size, F.lit(power))
    return F.when(size <= window + 1, F.lit(1)).otherwise(F.ceil(F.lit(math.log(1 - recall)) / F.log1p(-hit)).cast("int"))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m /= np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _usable(kind: str):
    """(vec_id, box, v) of vectors that can be compared: v holds the components as they came, box their number and the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            lens = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            first = lists.offsets.to_numpy()[: len(b)]
            flat = pc.fill_null(lists.values, float("nan")).to_numpy(zero_copy_only=False)
            for size in np.unique(lens[lens > 0]):
                rows = np.flatnonzero(lens == size)
                m = flat[first[rows][:, None] + np.arange(size)]
                fine = np.isfinite(m).all(1) & (m != 0).any(1)
                rows, m = rows[fine], np.ascontiguousarray(m[fine]).astype(kind)
                mine = b.select(["vec_id", "label"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([mine.column(0), pa.array([f"{size}/{x}" for x in mine.column(1).to_pylist()], pa.string()), pa.array([x.tobytes() for x in m], pa.binary())], ["vec_id", "box", "v"])

    return run


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _keyed(kind: str, low: int, high: int):
    """Rows of the passes from `low` up to `high`: pass, box, the vector's signs under the pass's projections, class and v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple, np.ndarray] = {}
        for b in batches:
            lens = np.array([len(x) for x in b.column("v").to_pylist()])
            for size in np.unique(lens):
                mine = b.filter(pa.array(lens == size))
                m = _unit(_matrix(mine.column("v"), kind))
                wanted = mine.column("passes").to_numpy()
                for k in range(low, high):
                    rows = np.flatnonzero(wanted > k)
                    if not len(rows):
                        continue
                    if (k, m.shape[1]) not in planes:
                        planes[k, m.shape[1]] = np.random.default_rng([SEED, k, m.shape[1]]).standard_normal((m.shape[1], HASHES))
                    signs = np.packbits(m[rows] @ planes[k, m.shape[1]] > 0, axis=1)
                    some = mine.select(["box", "class", "v"]).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), some.column(0), pa.array([x.tobytes() for x in signs], pa.binary()), some.column(1), some.column(2)], ["pass", "box", "sign", "class", "v"])

    return run


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and of b have a cosine of `threshold` or more."""
    cosine = a @ b.T
    near = cosine >= threshold
    i, j = np.nonzero(np.abs(cosine - threshold) < CLOSE)
    if len(i):
        near[i, j] = (a[i] * b[j]).sum(1) >= threshold
    return near


def _join(head: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make the components of i[k] and j[k] one, for each k; head is the first member of each one's component, before and after."""
    while True:
        p, q = head[i], head[j]
        apart = p != q
        if not apart.any():
            return
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(head, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = head[head]
            if (up == head).all():
                break
            head[:] = up


def window_links(m: np.ndarray, window: int, threshold: float) -> np.ndarray:
    """Of unit vectors in order: the first member of each one's component, by pairs of the threshold at most `window` places apart."""
    head = np.arange(len(m))
    step = max(1, min(window, TILE // (2 * window)))
    for s in range(0, len(m), step):
        here = m[s : s + step]
        ahead = m[s : s + step + window]
        near = _near(here, ahead, threshold)
        i, j = np.nonzero(near)
        fits = (j > i) & (j - i <= window)
        _join(head, s + i[fits], s + j[fits])
    return head


_FOUND = "a long, b long, pass int, box string, sign binary, class long, v binary, task int"


def _links(ids: np.ndarray, m: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    head = window_links(m, window, threshold)
    apart = np.flatnonzero(head != np.arange(len(head)))
    return ids[apart], ids[head[apart]]


def _windows(kind: str, window: int, threshold: float):
    """From rows in order: (a, b) for each vector joined with an earlier one, and this task's first and last rows, which may have neighbours in others."""

    def pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = [pa.nulls(len(a), t) for t in (pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], ["a", "b", "pass", "box", "sign", "class", "v", "task"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()

        def edge(t: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in t.combine_chunks().to_batches():
                none = pa.nulls(len(b), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *b.columns, pa.array(np.full(len(b), me, np.int32))], ["a", "b", "pass", "box", "sign", "class", "v", "task"])

        seen, last, held = 0, None, None
        for b in batches:
            if not len(b):
                continue
            if seen < window:
                yield from edge(pa.Table.from_batches([b.slice(0, window - seen)]))
            fresh = pa.Table.from_batches([b.slice(max(0, window - seen))])
            last = fresh if last is None else pa.concat_tables([last, fresh])
            last = last.slice(max(0, len(last) - window)).combine_chunks()
            seen += len(b)
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if len(held) >= 4 * window:
                yield from (pairs(*x) for x in _runs(held, kind, window, threshold))
                held = held.slice(len(held) - window)
        if held is not None:
            yield from (pairs(*x) for x in _runs(held, kind, window, threshold))
            yield from edge(last)

    return run


def _runs(t: pa.RecordBatch | pa.Table, kind: str, window: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of rows in order, by runs of one pass and box."""
    k, box, ids, v = t.column("pass").to_numpy(), t.column("box").to_pylist(), t.column("class").to_numpy(), t.column("v")
    s = 0
    while s < len(ids):
        e = s + 1
        while e < len(ids) and k[e] == k[s] and box[e] == box[s]:
            e += 1
        if e - s > 1:
            yield _links(ids[s:e], _unit(_matrix(v.slice(s, e - s), kind)), window, threshold)
        s = e


def _across(kind: str, window: int, threshold: float):
    """Links over the edges of tasks that follow each other."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("pass", "ascending"), ("box", "ascending"), ("sign", "ascending"), ("class", "ascending")]).combine_chunks()
        found = list(_runs(t, kind, window, threshold))
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[side] for x in found)]) for side in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _pass_links(classes: DataFrame, low: int, high: int, rows: int, kind: str, window: int, threshold: float) -> DataFrame:
    """(a, b) links found in the passes from `low` up to `high`, written."""
    keyed = classes.where(F.col("passes") > low).mapInArrow(_keyed(kind, low, high), "pass int, box string, sign binary, class long, v binary")
    order = ["pass", "box", "sign", "class"]
    ordered = keyed.repartitionByRange(max(1, -(-rows * (high - low) // ROWS_A_TASK)), *order).sortWithinPartitions(*order)
    found = cut(ordered.mapInArrow(_windows(kind, window, threshold), _FOUND), "passes")
    edges = found.where("task IS NOT NULL")
    groups = F.array(F.floor(F.col("task") / EDGES_AT_ONCE) * 2, F.floor((F.col("task") + EDGES_AT_ONCE // 2) / EDGES_AT_ONCE) * 2 + 1)
    met = edges.select(F.explode(groups).alias("group"), *order, "v").groupBy("group", "pass").applyInArrow(_across(kind, window, threshold), "a long, b long")
    links = cut(found.where("task IS NULL").select("a", "b").union(met).distinct(), "links")
    discard(found)
    return links


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are compared only if their labels are equal and not null (and they have equally many components), by cosine in
    double precision. Null or zero vectors and those with null or non-finite components link with nothing. Equal vectors of a
    label collapse to one class first. In each pass classes are ordered by their label and by the concatenated signs of HASHES random
    projections, and each is compared with its `window` neighbours on both sides, over the edges of tasks too; pairs of `threshold` or
    more are links. Passes differ in their projections, and a label has as many as its number of classes asks for
    (passes_for): one, which compares all its pairs, up to `window` + 1 classes. The union of the passes' pairs gives components, and
    then the links of each class are counted among all classes of its component, block against block where that is large. So a
    link is lost only where no pass joins its two sides by any chain of links.

    A pass sends each vector once, as it came, and a task gives one edge a vector at most, however many links it has. Counting costs
    products that grow with the square of a component, not of a label. A vec_id that is repeated stands for its rows together: the most
    links, and the smallest component_id, of any of them. A null vec_id names no component. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    of = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    usable = cut(of.where("label IS NOT NULL AND embedding IS NOT NULL").mapInArrow(_usable(kind), "vec_id long, box string, v binary"), "usable")
    grouped = usable.groupBy("box", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("many"))
    classes = cut(grouped.select(F.monotonically_increasing_id().alias("class"), "box", "v", "first", "many"), "classes")
    sizes = classes.groupBy("box").agg(F.count("*").alias("size")).where("size > 1").withColumn("passes", passes_for(F.col("size"), threshold, window, recall))
    compared = classes.join(sizes, "box").select("class", "box", "v", "passes")
    rows = {r["passes"]: r["n"] for r in sizes.groupBy("passes").agg(F.sum("size").alias("n")).collect()}  # a row for each number of passes
    most = max(rows, default=0)
    links = None
    for low in range(0, most, PASSES_AT_ONCE):
        if low:
            spark.sparkContext._jvm.System.gc()  # lets Spark delete the shuffle files of the passes before
        found = _pass_links(compared, low, min(most, low + PASSES_AT_ONCE), sum(n for k, n in rows.items() if k > low), kind, window, threshold)
        links = found if links is None else links.union(found)
    if links is None:
        links = classes.select(F.col("class").alias("a"), F.col("class").alias("b")).limit(0)
    roots = cut(connected_components(links, "a", "b"), "roots")
    members = classes.join(roots, classes["class"] == roots["node"]).select("class", "box", "v", "first", "many", "root")
    members = cut(members, "members")
    counted = _count_links(members, sum(rows.values()), threshold, kind).groupBy("class").agg(F.sum("n").alias("n"))
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    ends = cut(members.join(least, "root").select("class", "component_id").join(counted, "class", "left").select(F.col("class").alias("_class"), "component_id", "n"), "ends")
    joined = classes.join(ends, F.col("class") == F.col("_class"), "left")
    named = joined.select("box", "v", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    answer = usable.join(named, ["box", "v"]).select(F.col("vec_id").alias("_id"), "n_links", "component_id")
    answer = cut(answer.groupBy("_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "answer")
    out = of.select("vec_id").join(answer, F.col("vec_id") == F.col("_id"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _count_links(members: DataFrame, most: int, threshold: float, kind: str) -> DataFrame:
    """(class, n) sums to each class's links to others of its component, a class of many vectors counting for all of them.

    Components of up to BLOCK classes meet some at a time in one group; of a larger one each pair of its blocks is a group. There are
    `most` members at most."""
    sizes = cut(members.groupBy("root").agg(F.count("*").alias("size")), "components")
    groups = max(1, -(-most // (2 * BLOCK)))
    placed = members.join(sizes, "root").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    small = placed.where("blocks = 1").select(F.pmod(F.xxhash64("root"), F.lit(groups)).alias("group"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("block"), "root", "class", "v", "many")
    large = placed.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(F.lit(-1).cast("long").alias("group"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "root", "class", "v", "many")
    with_root = F.when(F.col("group") >= 0, F.lit(-1)).otherwise(F.col("root")).alias("whole")
    return small.union(large).withColumn("whole", with_root).groupBy("group", "whole", "x", "y").applyInArrow(_counter(threshold, kind), "class long, n long")


def _counter(threshold: float, kind: str):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("root").combine_chunks()
        ids, many, block, root = (t.column(c).to_numpy() for c in ("class", "many", "block", "root"))
        x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
        n = np.zeros(len(ids), np.int64)
        begins = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]]))
        ends = np.append(begins[1:], len(root))
        raw = t.column("v").combine_chunks()
        for s, e in zip(begins.tolist(), ends.tolist(), strict=True):
            m = _unit(_matrix(raw.slice(s, e - s), kind))
            a, b = (s + np.flatnonzero(block[s:e] == k) for k in (x, y))
            rows = max(1, TILE // max(1, len(b)))
            for k in range(0, len(a), rows):
                some = a[k : k + rows]
                near = _near(m[some - s], m[b - s], threshold)
                if x == y:
                    near[np.arange(len(some)), k + np.arange(len(some))] = False
                else:
                    n[b] += many[some] @ near
                n[some] += near @ many[b]
        return pa.table({"class": pa.array(ids), "n": pa.array(n)})

    return run
