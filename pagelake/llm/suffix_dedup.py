"""Repeated passages by sparse suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, ship
from .text import BYTE_BASE, U64, WORD_BASE, hash_spans, mix, ngram_hashes, pieces, row_bounds, words

#: A passage of so many words or more counts as repeated.
MIN_WORDS = 50
#: Words of the runs whose hashes choose positions, and consecutive runs among which one is chosen.
GRAM, WINDOW = 5, 24
#: A chosen position in each repeated passage has so many words of the passage from it on.
RIGHT = MIN_WORDS - WINDOW + 1
#: Words before a position and beyond its first RIGHT that are kept for extending a match.
REACH = WINDOW
#: A class with this share of all suffixes or more is joined by broadcast: there are 1 / HOT_SHARE of them at most.
HOT_SHARE = 0.001


def anchors(word_hashes: np.ndarray) -> np.ndarray:
    """Minimiser positions of one text's words: of each WINDOW runs of GRAM words the leftmost with the least hash."""
    grams = ngram_hashes(word_hashes, GRAM)
    if not len(grams):
        return np.zeros(0, np.int64)
    if len(grams) <= WINDOW:
        return np.array([int(grams.argmin())])
    return np.unique(sliding_window_view(grams, WINDOW).argmin(1) + np.arange(len(grams) - WINDOW + 1))


def suffixes(docs: DataFrame) -> DataFrame:
    """(key, whole, doc_id, pos, before, after) of every retained suffix.

    key is the hash of its first RIGHT words; shorter suffixes can't begin a repeat. before and after are the words there are
    before it and after those, REACH at most, and whole is the hash of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("text")):
                s, e, rows = words(data, offsets)
                h = hash_spans(data, s, e)
                bounds = row_bounds(rows, hi - lo)
                at = [anchors(h[bounds[r] : bounds[r + 1]]) + bounds[r] if bounds[r + 1] - bounds[r] >= MIN_WORDS else np.zeros(0, np.int64) for r in range(hi - lo)]
                row = np.repeat(np.arange(hi - lo), [len(x) for x in at])
                pos = np.concatenate(at).astype(np.int64)
                fits = pos + RIGHT <= bounds[row + 1]
                row, pos = row[fits], pos[fits]
                if not len(pos):
                    continue
                before = np.minimum(REACH, pos - bounds[row])
                after = np.minimum(REACH, bounds[row + 1] - pos - RIGHT)
                key = hash_spans(h, pos, pos + RIGHT)
                whole = mix(hash_spans(h, pos - before, pos + RIGHT + after) + (before * (REACH + 1) + after).astype(U64))
                columns = [key.view(np.int64), whole.view(np.int64), (pos - bounds[row]).astype(np.int32), before.astype(np.int8), after.astype(np.int8)]
                columns = list(map(pa.array, columns))
                columns.insert(2, batch.column("doc_id").take(pa.array(row + lo)))
                yield pa.RecordBatch.from_arrays(columns, ["key", "whole", "doc_id", "pos", "before", "after"])

    return docs.mapInArrow(run, "key long, whole long, doc_id long, pos int, before byte, after byte")


def _contexts(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """(key, near, far, doc_id, pos): the REACH words before each marked position, last first, and those after its first RIGHT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch.column("text")):
                s, e, rows = words(data, offsets)
                every = hash_spans(data, s, e)
                bounds = row_bounds(rows, hi - lo)
                for r in range(hi - lo):
                    h = every[bounds[r] : bounds[r + 1]]
                    pos = np.sort(np.array(batch.column("at")[lo + r].as_py(), np.int64))
                    pos = pos[pos + RIGHT <= len(h)]
                    if not len(pos):
                        continue
                    code = (h >> U64(32)).astype(">u4")
                    padded = np.concatenate([np.zeros(REACH, ">u4"), code, np.zeros(REACH, ">u4")])
                    view = sliding_window_view(padded, REACH)
                    near = np.ascontiguousarray(view[pos][:, ::-1])
                    far = np.ascontiguousarray(view[pos + REACH + RIGHT])
                    raw = lambda x: pa.array([y.tobytes() for y in x], pa.binary())
                    doc = batch.column("doc_id").slice(lo + r, 1).take(pa.array([0] * len(pos)))
                    yield pa.RecordBatch.from_arrays([pa.array(hash_spans(h, pos, pos + RIGHT).view(np.int64)), raw(near), raw(far), doc, pa.array(pos.astype(np.int32))], ["key", "near", "far", "doc_id", "pos"])

    return docs.join(marked.hint("merge"), "doc_id").select("doc_id", "text", "at").mapInArrow(run, "key long, near binary, far binary, doc_id long, pos int")


_SPANS = "doc_id long, from long, upto long, other_doc long, other_from long"
#: Suffixes compared in memory at a time, and of one key the most that are; more are compared over the cluster.
AT_ONCE, LONGEST_RUN = 8192, 1 << 16


def _shared(key: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """How many first codes each row shares with the row before it, of rows in order by key and codes; -1 where the key is another. Zero stands for no word."""
    same = (codes[1:] == codes[:-1]) & (codes[1:] != 0)
    many = np.where(same.all(1), codes.shape[1], same.argmin(1))
    return np.concatenate([[-1], np.where(key[1:] == key[:-1], many, -1)])


def _raw(codes: np.ndarray) -> np.ndarray:
    """Rows of codes as bytes that sort as the codes do."""
    return np.ascontiguousarray(codes.astype(">u4")).view(f"S{4 * codes.shape[1]}").ravel()


def _extended(key, doc, pos, near, far) -> list[np.ndarray]:
    """Spans of the later of suffixes with equal first words, extended left and right: doc, from, upto, the earliest doc and where its copy begins.

    Rows come by key, then by what follows to the right, or, seen from the left end, by what stands before: in either order a row's
    neighbours share most with it on that side, and rows that share m words or more are runs between neighbours that share fewer. A
    passage of MIN_WORDS words that begins o words before a suffix is shared by those in one run on both sides, of o
    words to the left and the rest to the right."""
    order = np.lexsort((pos, doc, key))
    again = np.flatnonzero((key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (pos[order][1:] == pos[order][:-1])) + 1
    if len(again):  # of a document whose row is repeated
        key, doc, pos, near, far = (np.delete(x, order[again], 0) for x in (key, doc, pos, near, far))
    n, more = len(key), MIN_WORDS - RIGHT
    runs = []
    for codes in (near, far):
        order = np.lexsort((_raw(codes), key))
        many, back = _shared(key[order], codes[order]), np.empty(n, np.int64)
        back[order] = np.arange(n)
        starts = many[:, None] < np.arange(more + 1)  # by words shared: where a run begins
        runs.append(np.cumsum(starts, 0)[back])
    has = [np.concatenate([np.ones((n, 1), bool), codes[:, :more] != 0], 1) for codes in (near, far)]
    order = np.lexsort((pos, doc))
    first = np.full((n, more + 1), -1)
    for o in range(more + 1):
        rows = order[(has[0][:, o] & has[1][:, more - o])[order]]
        both = runs[0][rows, o] * (n + 1) + runs[1][rows, more - o]
        by = np.argsort(both, kind="stable")
        rows, both = rows[by], both[by]
        new = np.concatenate([[True], both[1:] != both[:-1]]) if len(rows) else np.zeros(0, bool)
        lead = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))] if len(rows) else rows
        first[rows[~new], o] = lead[~new]
    later = first >= 0
    ends = later & ~np.concatenate([later[:, 1:], np.zeros((n, 1), bool)], 1)  # the largest offset of a run: where its span begins
    starts = later & ~np.concatenate([np.zeros((n, 1), bool), later[:, :-1]], 1)
    r, high = np.nonzero(ends)
    _, low = np.nonzero(starts)
    other = first[r, high]
    return [doc[r], pos[r] - high, pos[r] - low + MIN_WORDS, doc[other], pos[other] - high]


def _window_keys(key, near, far) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether they hold) by suffix and offset o: of the MIN_WORDS words that begin o words before the suffix."""
    n, more = len(key), MIN_WORDS - RIGHT
    left, right = np.zeros((n, more + 1), U64), np.zeros((n, more + 1), U64)
    has_left, has_right = np.ones((n, more + 1), bool), np.ones((n, more + 1), bool)
    for i in range(more):
        left[:, i + 1] = left[:, i] * U64(WORD_BASE) + near[:, i].astype(U64) + U64(1)
        right[:, i + 1] = right[:, i] * U64(BYTE_BASE) + far[:, i].astype(U64) + U64(1)
        has_left[:, i + 1] = has_left[:, i] & (near[:, i] != 0)
        has_right[:, i + 1] = has_right[:, i] & (far[:, i] != 0)
    o = np.arange(more + 1)
    h = mix(key.view(U64)[:, None] + mix(left + o.astype(U64)) + mix(right[:, ::-1] ^ U64(0x5DEECE66D)))
    return h, has_left & has_right[:, ::-1]


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    rows = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "doc_id", "pos")]
    return rows + [np.frombuffer(b"".join(b.column(c).to_pylist()), ">u4").reshape(len(b), REACH).astype(np.uint32) for c in ("near", "far")]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans from rows in suffix order, some thousand at a time, always whole runs of equal first words: no run goes on in another partition."""
    held: list[np.ndarray] | None = None

    def settle(rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _extended(*rows)], ["doc_id", "from", "upto", "other_doc", "other_from"])

    for b in batches:
        if len(b):
            held = _columns(b) if held is None else [np.concatenate(x) for x in zip(held, _columns(b), strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last >= AT_ONCE:
                yield settle([x[:last] for x in held])
                held = [x[last:] for x in held]
    if held is not None:
        yield settle(held)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(window, doc, start) of all windows around suffixes."""
    for b in batches:
        if len(b):
            key, doc, pos, near, far = _columns(b)
            h, ok = _window_keys(key, near, far)
            r, o = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(h[r, o].view(np.int64)), pa.array(doc[r]), pa.array(pos[r] - o)], ["window", "doc", "start"])


def _over_the_cluster(rows: DataFrame) -> DataFrame:
    """Spans of suffixes of which very many share their first words: equal windows meet by their keys, each with the earliest of it."""
    loose = cut(rows.mapInArrow(_windows, "window long, doc long, start long"), "windows")
    leads = loose.groupBy("window").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("f")).where("n > 1").select("window", F.col("f.doc").alias("doc2"), F.col("f.start").alias("start2"))
    met = loose.join(leads, "window").where("doc != doc2 OR start != start2")
    return met.select(F.col("doc").alias("doc_id"), F.col("start").alias("from"), (F.col("start") + MIN_WORDS).alias("upto"), F.col("doc2").alias("other_doc"), F.col("start2").alias("other_from"))


def _apart(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with a number for each document in a column `name`, and the table (row, of) of the doc_ids of numbers that are none themselves.

    The number is the doc_id; texts of one doc_id that differ have numbers beyond all doc_ids, by which each is a document of its own."""
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("of"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    shared = cut(texts.groupBy("of").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low != high").select("of"), "shared_ids")
    if shared.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), None
    low, high = texts.agg(F.min("of"), F.max("of")).first()
    if max(-low, high) >= 1 << 62:
        raise ValueError("documents that share a doc_id need doc_ids within 62 bits")
    numbers = texts.join(shared, "of", "left_semi").distinct().select("of", F.col("h").alias("text_hash"), (F.monotonically_increasing_id() + high + 1).alias("row"))
    numbers = cut(numbers, "numbers")
    same = (docs["doc_id"].cast("long") == numbers["of"]) & (F.xxhash64(docs["text"].cast("string")) == numbers["text_hash"])
    own = [docs[f"`{c}`"] for c in docs.columns]
    return docs.join(numbers, same, "left").select(*own, F.coalesce(numbers["row"], docs["doc_id"].cast("long")).alias(name)), numbers.select("row", "of")


def repeats(docs: DataFrame) -> DataFrame:
    """Repeated passages: doc_id, first_word, n_words, copy_of (doc_id of an earlier copy), copy_first_word.

    Words are runs of anything but ASCII white space. A passage of MIN_WORDS words or more that stands earlier too, in
    a document of smaller doc_id or further up in the same one, is reported where it stands later; passages of one document that touch
    are joined, and then copy_of is the earliest document of the first of them. So removing what is reported leaves
    each passage once. Suffixes are retained at minimiser positions, and those whose first RIGHT words occur once are
    dropped after a count. Suffixes that agree in all words within REACH are one class: all but the first of it are reported at
    once. The first suffixes of classes are sorted over the cluster, by their first words, then the words before and after;
    neighbours of equal first words are compared and extended left and right, all runs of them alike. Where more than LONGEST_RUN meet in
    one run, the windows of MIN_WORDS words around them are compared over the cluster by their keys, with the same result, so that no task
    holds more of one passage. Rows without doc_id or text take no part, and rows that repeat both a doc_id and its text count once.
    Different texts of one doc_id are documents of their own, later than all others. The first pass over the texts runs twice,
    as keeping its rows costs more disk than the count needs.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    numbered, names = _apart(docs, "row")
    one = _repeats(numbered.select(F.col("row").alias("doc_id"), "text"))
    if names is None:
        return one
    for c in ("doc_id", "copy_of"):
        renamed = names.select(F.col("row").alias("_row"), F.col("of").alias("_of"))
        one = one.join(renamed, one[c] == renamed["_row"], "left").withColumn(c, F.coalesce("_of", c)).drop("_row", "_of")
    return one


def _repeats(docs: DataFrame) -> DataFrame:
    """repeats() of documents whose doc_id tells them apart."""
    often = cut(suffixes(docs).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "often")
    kept = cut(suffixes(docs).join(often, "key", "left_semi"), "suffixes")
    classes = cut(kept.groupBy("key", "whole").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("f")).select("key", "whole", "n", F.col("f.doc_id").alias("doc_id"), F.col("f.pos").alias("pos")), "classes")
    firsts = classes.where("n > 1").select("key", "whole", "n", F.col("doc_id").alias("doc2"), F.col("pos").alias("pos2"))
    hot = float(classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) * HOT_SHARE
    long = kept.where(F.col("before") + RIGHT + F.col("after") >= MIN_WORDS)
    many = F.broadcast(firsts.where(F.col("n") >= hot))
    equal = long.join(many, ["key", "whole"]).unionByName(long.join(many.select("key", "whole"), ["key", "whole"], "left_anti").join(firsts.where(F.col("n") < hot), ["key", "whole"]))
    equal = equal.where("doc_id != doc2 OR pos != pos2")
    equal = equal.select("doc_id", (F.col("pos") - F.col("before")).cast("long").alias("from"), (F.col("pos") + RIGHT + F.col("after")).cast("long").alias("upto"), F.col("doc2").alias("other_doc"), (F.col("pos2") - F.col("before")).cast("long").alias("other_from"))
    shared = cut(classes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    marked = classes.join(shared.select("key"), "key", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("at"))
    rows = cut(_contexts(docs, marked), "contexts")
    crowded = shared.where(F.col("n") > LONGEST_RUN).select("key")
    spans = equal
    if not crowded.isEmpty():
        spans = spans.union(_over_the_cluster(rows.join(crowded, "key", "left_semi").select(*rows.columns)))
        rows = rows.join(crowded, "key", "left_anti").select(*rows.columns)
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key", "near", "far", "doc_id", "pos")
    spans = spans.union(ordered.mapInArrow(_neighbours, _SPANS))
    # spans that touch are one: a new one begins beyond the end of all before it
    each = spans.groupBy("doc_id", "from").agg(F.max("upto").alias("upto"), F.min(F.struct("upto", "other_doc", "other_from")).alias("other"))
    order = Window.partitionBy("doc_id").orderBy("from")
    before = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("begins", F.when(F.col("from") <= before, 0).otherwise(1)).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = each.groupBy("doc_id", "run").agg(F.min("from").alias("first_word"), F.max("upto").alias("upto"), F.min(F.struct("from", "other")).alias("o"))
    return one.select("doc_id", "first_word", (F.col("upto") - F.col("first_word")).alias("n_words"), F.col("o.other.other_doc").alias("copy_of"), F.col("o.other.other_from").alias("copy_first_word"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs without the reported passages; n_chars follows the text. A document of which no word is left goes.

    Rows that repeat a doc_id and its text are cut alike; different texts of one doc_id are documents of their own."""
    ship(docs.sparkSession)
    row, cuts = fresh(docs, "row_number"), fresh(docs, "cuts")
    numbered, _ = _apart(docs, row)
    usable = numbered.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col(row).alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = cut(_repeats(usable).groupBy(F.col("doc_id").alias(row)).agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias(cuts)), "cuts")
    joined = numbered.join(spans.hint("merge"), row, "left")  # spans grow with the documents: the same plan at every size
    own = [F.col(f"`{c}`") for c in docs.columns]
    whole = joined.where(F.col(cuts).isNull()).select(*own)
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, keep = [], []
            every = b.column(len(names)).to_pylist()
            for lo, hi, data, offsets in pieces(b.column(at)):
                s, e, rows = words(data, offsets)
                bounds = row_bounds(rows, hi - lo)
                for r in range(hi - lo):
                    raw = data[offsets[r] : offsets[r + 1]].tobytes()
                    parts, upto = [], 0
                    for c in every[lo + r]:
                        first = bounds[r] + c["first_word"]
                        parts.append(raw[upto : s[first] - offsets[r]])
                        upto = int(e[first + c["n_words"] - 1] - offsets[r])
                    left = b"".join([*parts, raw[upto:]])
                    keep.append(bool(left.split()))
                    out.append(left.decode())
            columns = [b.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, columns[at].type)
            if chars is not None:
                columns[chars] = pa.array([len(x) for x in out]).cast(columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return whole.union(joined.where(F.col(cuts).isNotNull()).select(*own, cuts).mapInArrow(run, docs.schema))
