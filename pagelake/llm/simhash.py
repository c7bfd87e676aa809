"""SimHash near-duplicate detection with deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import connected_components, cut, fresh, ship
from .text import LOWER, pieces, row_bounds, words, xxh64

SHINGLE, SEED, BITS, MAX_DISTANCE = 3, 42, 64, 2
#: One-wildcard buckets of up to so many fingerprints are compared pairwise; larger ones are keyed more finely, and so are
#: segments that more than CROWDED fingerprints share, before they come to a bucket: then no bucket exceeds 2 * CROWDED.
PAIRWISE, CROWDED = 32, 4096


#: Shingles hashed at a time, and the most whose bits are added up in one byte each.
AT_ONCE, IN_A_BYTE = 1 << 18, 255
#: Each byte's eight bits as eight bytes.
_SPREAD = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def _votes(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How often each of 64 bits is set in the hashes of each row, which ascend."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    count = np.diff(np.append(first, len(row)))
    parts = -(-count // IN_A_BYTE)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(first, parts) + nth * IN_A_BYTE
    sums = np.add.reduceat(_SPREAD[h.astype("<u8").view(np.uint8).reshape(-1, 8)], begin, axis=0)
    out = np.zeros((rows, BITS), np.int64)
    np.add.at(out, row[begin], sums.astype("<u8").view(np.uint8).reshape(-1, BITS))
    return out


def fingerprint_all(column: pa.Array) -> np.ndarray:
    """The 64 majority bits of the XXH64 values of each text's word shingles, as signed longs."""
    out = []
    for lo, hi, data, offsets in pieces(column):
        data = LOWER[data]
        s, e, rows = words(data, offsets)
        n = np.diff(row_bounds(rows, hi - lo))
        # the words again with one space behind each: a shingle is a span of them
        size = e - s + 1
        at = np.cumsum(size) - size
        joined = data[np.minimum(np.arange(size.sum()) - np.repeat(at - s, size), len(data) - 1)] if len(s) else data[:0]
        joined[at + size - 1] = 32
        shingles = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
        row = np.repeat(np.arange(hi - lo), shingles)
        first = np.arange(len(row)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + np.repeat(np.cumsum(n) - n, shingles)
        last = first + np.minimum(n[row], SHINGLE) - 1
        votes = np.zeros((hi - lo, BITS), np.int64)
        for k in range(0, len(row), AT_ONCE):  # bounded memory for a very long text
            part = slice(k, k + AT_ONCE)
            h = xxh64(joined, at[first[part]], at[last[part]] + size[last[part]] - 1, SEED)
            votes += _votes(h, row[part], hi - lo)
        out.append(np.packbits(2 * votes > shingles[:, None], axis=1, bitorder="little").view("<i8").ravel())
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text."""
    return int(fingerprint_all(pa.array([text], pa.string()))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; a text without words has fingerprint zero."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint_all(b.column(1)))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def hamming_links(fps: DataFrame, name: str = "fp") -> DataFrame:
    """(lo, hi) links between distinct 64-bit values of `name` that differ in at most two bits.

    Cut into two 32-bit segments, one of them differs by at most one bit; so each value is indexed under the 64
    variants of its segments that have one bit wiped out, and equal variants are verified. Of a pair of values all links
    are returned when a bucket has up to PAIRWISE members. Values in larger buckets are indexed under all variants
    with two of the 64 bits wiped out, which at most four values share: there every link is returned as it is or through
    a chain of links, in a number that grows with the members and not with their square. Values of a crowded segment, and those
    that differ from it in one bit, go there at once. Rows are shuffled by bucket once.
    """
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fps = cut(fps.select(F.col(name).alias("fp")).distinct().repartition(parts, "fp"), "distinct").repartition(parts, "fp")
    near = F.expr(f"bit_count(lo ^ hi) <= {MAX_DISTANCE}")
    half = F.when(F.col("s") == 0, F.expr("fp & 4294967295")).otherwise(F.expr("shiftrightunsigned(fp, 32)"))
    halves = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("s")).select("fp", "s", half.alias("half"))
    crowded = cut(halves.groupBy("s", "half").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("s", "half"), "crowded")
    flips = F.concat(F.array("half"), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda t: F.col("half").bitwiseXOR(F.pow(F.lit(2.0), t).cast("long"))))
    beside = crowded.select("s", F.explode(flips).alias("half")).distinct()
    sparse = halves.join(crowded, ["s", "half"], "left_anti")
    keyed = sparse.select("fp", "s", "half", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("t"))
    keyed = keyed.select("fp", F.expr("(half & ~shiftleft(1L, t)) + shiftleft(cast(s * 32 + t as bigint), 32)").alias("key"))
    buckets = keyed.repartition(parts, "key").groupBy("key").agg(F.collect_list("fp").alias("m")).where(F.size("m") > 1)
    buckets = cut(buckets.select("m"), "buckets")
    few = buckets.where(F.size("m") <= PAIRWISE).distinct()
    linked = f"flatten(transform(m, x -> transform(filter(m, y -> x < y AND bit_count(x ^ y) <= {MAX_DISTANCE}), y -> named_struct('lo', x, 'hi', y))))"
    pairs = few.select(F.explode(F.expr(linked)).alias("p")).select("p.lo", "p.hi")
    many = buckets.where(F.size("m") > PAIRWISE).select(F.explode("m").alias("fp")).union(halves.join(beside, ["s", "half"], "left_semi").select("fp")).distinct()
    two = many.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    two = two.select("fp", F.expr("fp & ~shiftleft(1L, i) & ~shiftleft(1L, j)").alias("rest"), F.expr("i * 64 + j").alias("mask"))
    shared = two.groupBy("mask", "rest").agg(F.min("fp").alias("lo"), F.max("fp").alias("top"), F.collect_set("fp").alias("all")).where("lo < top")
    stars = shared.select("lo", F.explode("all").alias("hi")).where("lo < hi").where(near)
    return pairs.union(stars).distinct()


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, root (a fingerprint that names its component) and component_id."""
    fps = cut(fingerprints(docs, id_col, text_col), "fps")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(hamming_links(classes), "lo", "hi").select(F.col("node").alias("fp"), "root")
    classes = cut(classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    linked = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(classes.join(linked, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in two bits or fewer are linked; component_id is the smallest doc_id
    reachable. Equal fingerprints collapse to one class before anything is compared, so a group of exact copies
    costs one row. A null or empty text has fingerprint zero and links like any other; repeated rows give repeated
    rows; a null doc_id never names a component; an empty table gives none.
    """
    return components(docs, id_col, text_col).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """docs and the fingerprint of text in a column `name`."""
    ship(docs.sparkSession)
    names = [*docs.columns, name]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fingerprint_all(b.column(at)))], names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates: the one with the smallest doc_id, of several the one with the smallest fingerprint, then text hash.

    Texts of one doc_id that aren't near duplicates are documents of their own. Rows without doc_id stay, as no group
    can be told for them. Only doc_ids are joined; fingerprints are taken again of rows that share theirs.
    """
    found = cut(components(docs).where("doc_id IS NOT NULL").select("doc_id", "fp", "root"), "found")
    leads = found.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("l")).select(F.col("l.doc_id").alias("id"), F.col("l.fp").alias("lead_fp"))
    rows = found.groupBy(F.col("doc_id").alias("of")).agg(F.count("*").alias("n"))
    chosen = cut(leads.join(rows, leads["id"] == rows["of"]).select("id", "lead_fp", "n"), "chosen")
    own = [F.col(f"`{c}`") for c in docs.columns]
    single = chosen.where("n = 1").select("id").hint("merge")  # decisions grow with the documents: the same plan at every size
    kept = docs.join(single, docs["doc_id"] == single["id"], "left_semi").union(docs.where("doc_id IS NULL"))
    several = chosen.where("n > 1")
    if several.isEmpty():
        return kept
    shared = several.select("id").distinct()
    fp, mark = fresh(docs, "fp_of_row"), fresh(docs, "text_hash")
    some = with_fingerprint(docs.join(shared, docs["doc_id"] == shared["id"], "left_semi"), fp)
    some = some.join(several, (some["doc_id"] == several["id"]) & (some[fp] == several["lead_fp"]), "left_semi").withColumn(mark, F.xxhash64("text"))
    least = some.groupBy(F.col("doc_id").alias("least_id"), F.col(fp).alias("least_fp")).agg(F.min(mark).alias("least_mark"))
    some = some.join(least, (some["doc_id"] == least["least_id"]) & (some[fp] == least["least_fp"]) & (some[mark] == least["least_mark"]), "left_semi")
    return kept.union(some.dropDuplicates(["doc_id", fp]).select(*own))
