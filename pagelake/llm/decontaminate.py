"""Benchmark decontamination: rare pairs of words join documents to items, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ship
from .text import U64, WORD_BASE, hash_spans, lower, mix, pieces, row_bounds, script_words

#: Items of fewer words match nothing.
LEAST_WORDS = 3
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Score of the best local alignment over the item's number of words, from which a document counts as a copy.
THRESHOLD = 0.5
#: Rare seeds that a place must share with an item to be aligned, or as many as the item's length assures; bits of the filter of seeds, as a power of 2.
HITS, FILTER_BITS = 3, 26


def _normal(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, hash of each word, word bounds of the rows): runs of letters and digits in lower case, single characters of scripts beyond U+0800."""
    for lo, hi, data, offsets in pieces(column):
        data = lower(data)
        s, e, rows = script_words(data, offsets)
        yield lo, hi, hash_spans(data, s, e), row_bounds(rows, hi - lo)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over words, all pairs in step: (best score, first word, last word + 1 in the window) of each."""
    n = len(items)
    a = np.zeros((n, max(map(len, items))), U64)
    b = np.ones((n, max(map(len, windows))), U64)
    for i, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[i, : len(x)] = np.where(x < 2, x + U64(2), x)
        b[i, : len(y)] = np.where(y < 2, y + U64(2), y)
    width = b.shape[1]
    ramp = np.arange(width + 1) * GAP
    score = np.zeros((n, width + 1))
    begin = np.broadcast_to(np.arange(width + 1), (n, width + 1)).copy()
    best, first, last = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    every = np.arange(n)
    for j in range(a.shape[1]):
        step = np.where(a[:, j : j + 1] == b, MATCH, MISMATCH)
        diagonal, above = score[:, :-1] + step, score[:, 1:] + GAP
        now = np.zeros_like(score)
        now[:, 1:] = np.maximum(diagonal, above)
        origin = begin.copy()
        origin[:, 1:] = np.where(diagonal >= above, begin[:, :-1], begin[:, 1:])
        fresh = now <= 0
        now[fresh] = 0
        origin[fresh] = np.broadcast_to(np.arange(width + 1), now.shape)[fresh]
        lifted = now - ramp  # a gap along the window: the best cell to the left, less the gap's cost
        top = np.maximum.accumulate(lifted, 1)
        source = np.maximum.accumulate(np.where(lifted >= top, np.arange(width + 1), 0), 1)
        score = top + ramp
        begin = np.take_along_axis(origin, source, 1)
        zero = score <= 0
        score[zero] = 0
        begin[zero] = np.broadcast_to(np.arange(width + 1), now.shape)[zero]
        place = score.argmax(1)
        high = score[every, place]
        up = high > best
        best[up], first[up], last[up] = high[up], begin[every, place][up], place[up]
    return best, first, last


def pair_seeds(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, row, place of the first word) of all pairs of words of a row that follow each other, or with one word between; by row and place."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    seeds, at = [], []
    for step in (1, 2):
        first = np.flatnonzero(row[:-step] == row[step:]) if len(row) > step else np.zeros(0, np.int64)
        seeds.append(mix(h[first] * U64(WORD_BASE) + h[first + step]))
        at.append(first)
    seed, place = np.concatenate(seeds), np.concatenate(at)
    order = np.argsort(place, kind="stable")
    return seed[order], row[place[order]], place[order]


def _bits(seed: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    return (seed >> U64(64 - power)).astype(np.int64), (seed & U64((1 << power) - 1)).astype(np.int64)


def _may_hold(bitmap: np.ndarray, seed: np.ndarray) -> np.ndarray:
    out = np.ones(len(seed), bool)
    for at in _bits(seed, len(bitmap).bit_length() + 2):
        out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
    return out


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """A Bloom filter of the column `seed`, of 2 ** FILTER_BITS bits whatever the number of seeds: a false hit costs a row and no more.

    Tasks give the blocks of it that they have set bits in, blocks meet by number, and what comes to the driver is the filter's size."""
    power, block = FILTER_BITS, 1 << 13

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (power - 3), np.uint8)
        for b in batches:
            for at in _bits(b.column(0).to_numpy().view(U64), power):
                np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in np.unique(np.flatnonzero(bits) // block):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bits[k * block : (k + 1) * block].tobytes()], pa.binary())], ["block", "bits"])

    def either(t: pa.Table) -> pa.Table:
        some = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t.column("bits").to_pylist()])
        return pa.table({"block": t.column("block").slice(0, 1), "bits": pa.array([some.tobytes()], pa.binary())})

    out = np.zeros(1 << (power - 3), np.uint8)
    for r in seeds.select("seed").mapInArrow(part, "block long, bits binary").groupBy("block").applyInArrow(either, "block long, bits binary").collect():
        out[r["block"] * block : r["block"] * block + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def _items(benchmark: DataFrame, threshold: float, least_words: int) -> DataFrame:
    """(item, item_id, n, words, share): words as hashes; of `share` pairs that follow each other in an alignment over the threshold one at least is a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, bounds in _normal(b.column(1)):
                n = np.diff(bounds)
                keep = np.flatnonzero(n >= least_words)
                blobs = [h[bounds[r] : bounds[r + 1]].astype("<u8").tobytes() for r in keep]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + keep)), pa.array(n[keep].astype(np.int32)), pa.array(blobs, pa.binary())], ["item_id", "n", "words"])

    some = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    some = some.mapInArrow(run, "item_id long, n int, words binary").distinct()
    good = F.greatest(F.lit(1), F.ceil(F.col("n") * threshold - 1 - 1e-9).cast("int"))
    return some.select(F.monotonically_increasing_id().alias("item"), "item_id", "n", "words", F.least(F.lit(HITS), good).alias("hits"), good.alias("good"))


def _item_seeds(items: DataFrame) -> DataFrame:
    """(item, seed, times) of all pairs of each item's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.frombuffer(blob, "<u8")
                seed, times = np.unique(pair_seeds(h, np.array([0, len(h)]))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seed), item)), pa.array(seed.view(np.int64)), pa.array(times)], ["item", "seed", "times"])

    return items.select("item", "words").mapInArrow(run, "item long, seed long, times long")


def _rare(docs: DataFrame, items: DataFrame, seeds: DataFrame) -> DataFrame:
    """(item, seed): the pairs of each item but the commonest of all documents, as many fewer as the guarantee allows."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in batches:
            for _, _, h, bounds in _normal(b.column(0)):
                seed = pair_seeds(h, bounds)[0]
                seed, n = np.unique(seed[_may_hold(bitmap, seed)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(n)], ["seed", "n"])

    counts = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    ranked = seeds.join(counts, "seed")  # pairs that stand in no document can't meet one
    upto = F.sum("times").over(Window.partitionBy("item").orderBy(F.desc("n"), "seed"))
    ranked = ranked.withColumn("upto", upto).join(items.select("item", "good", "hits"), "item")
    return ranked.where(F.col("upto") > F.col("good") - F.col("hits")).select("item", "seed")


def _windows(docs: DataFrame, rare: DataFrame, span: int, hits: int) -> DataFrame:
    """Runs of words of documents that hold `hits` rare seeds close together: doc_id, copy, start, words (hashes), seeds and at (their places)."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(rare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for b in batches:
            for lo, _, h, bounds in _normal(b.column(2)):
                seed, row, place = pair_seeds(h, bounds)
                mine = np.flatnonzero(_may_hold(bitmap, seed))
                seed, row, place = seed[mine], row[mine], place[mine]
                lead = np.concatenate([[True], place[1:] != place[:-1]]) if len(place) else np.zeros(0, bool)
                spots, at_row = place[lead], row[lead]  # a place counts once, however many seeds begin there
                if len(spots) < hits:
                    continue
                first, last = spots[: len(spots) - hits + 1], spots[hits - 1 :]
                close = (at_row[: len(first)] == at_row[hits - 1 :]) & (last - first < span)
                r = at_row[: len(first)][close]
                if not len(r):
                    continue
                low, high = np.maximum(last[close] - span + 1, bounds[r]), np.minimum(first[close] + span + 1, bounds[r + 1])
                begin = np.concatenate([[True], (low[1:] > high[:-1]) | (r[1:] != r[:-1])])
                low, high, r = low[begin], np.maximum.reduceat(high, np.flatnonzero(begin)), r[begin]
                s, e = np.searchsorted(place, low), np.searchsorted(place, high)
                take = lambda x, kind: pa.array([x[a:z] for a, z in zip(s, e, strict=True)], pa.list_(kind))  # noqa: E731, B023
                words_of = pa.array([h[a:z].astype("<u8").tobytes() for a, z in zip(low, high, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + r)), b.column(1).take(pa.array(lo + r)), pa.array((low - bounds[r]).astype(np.int32)), words_of, take(seed.view(np.int64), pa.int64()), pa.array([(place[a:z] - x).astype(np.int32) for a, z, x in zip(s, e, low, strict=True)], pa.list_(pa.int32()))], ["doc_id", "copy", "start", "words", "seeds", "at"])

    return docs.select("doc_id", "copy", "text").mapInArrow(run, "doc_id long, copy long, start int, words binary, seeds array<long>, at array<int>")


def _parts(at: np.ndarray, hits: int, span: int, size: int) -> Iterator[tuple[int, int]]:
    """Where in a window of `size` words an alignment can lie: about each `hits` places of its item's seeds that stand within `span`."""
    close = np.flatnonzero(at[hits - 1 :] - at[: len(at) - hits + 1] < span)
    low, high = np.maximum(at[close + hits - 1] - span + 1, 0), np.minimum(at[close] + span + 1, size)
    begin = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
    yield from zip(low[begin].tolist(), np.maximum.reduceat(high, begin).tolist(), strict=True)


def _held(windows: DataFrame, met: DataFrame, place: list[str]) -> DataFrame:
    """Rows of met with the words of their windows. Most windows have met no item, so a filter keeps them from being sent."""
    shared = windows.sparkSession.sparkContext.broadcast(_bitmap(met))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_may_hold(shared.value, b.column(0).to_numpy().view(U64))))

    some = windows.select(F.xxhash64(*place).alias("key"), *place, "words")
    some = some.mapInArrow(run, some.schema).hint("merge")  # the same plan at every size
    same = [some[c].eqNullSafe(met[f"_{c}"]) for c in place]
    return some.join(met, [some["key"] == met["seed"], *same]).drop("key", "seed")


def _aligned(threshold: float):
    """Rows (doc_id, copy, start, words, at, hits, item_id, own) as (doc_id, copy, item_id, score, first_word, n_words) where an alignment reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo = []
            for k, (blob, own, at, hits) in enumerate(zip(b.column("words"), b.column("own"), b.column("at"), b.column("hits"), strict=True)):
                h, item = np.frombuffer(blob.as_buffer(), "<u8"), np.frombuffer(own.as_buffer(), "<u8")
                least = threshold * MATCH * len(item)
                for low, high in _parts(np.array(at.as_py(), np.int64), hits.as_py(), span_of(len(item), threshold), len(h)):
                    # the best run with MATCH for each word that the item has and the lesser penalty for others: no alignment scores more
                    run = np.concatenate([[0.0], np.cumsum(np.where(np.isin(h[low:high], item), MATCH, max(MISMATCH, GAP)))])
                    if (run - np.minimum.accumulate(run)).max() >= least - 1e-9:
                        todo.append((k, item, h[low:high], low))
            todo.sort(key=lambda c: (len(c[2]), len(c[1])))
            out = []
            s = 0
            while s < len(todo):
                e = s + 1
                while e < len(todo) and (e - s + 1) * len(todo[e][2]) <= 40_000:
                    e += 1
                best, first, last = align([c[1] for c in todo[s:e]], [c[2] for c in todo[s:e]])
                out += [(c[0], float(x) / (MATCH * len(c[1])), c[3] + int(f), int(z - f)) for c, x, f, z in zip(todo[s:e], best, first, last, strict=True)]
                s = e
            out = [x for x in out if x[1] >= threshold]
            if out:
                k, score, first, length = (np.array(x) for x in zip(*out, strict=True))
                at = b.column("start").to_numpy()[k] + first
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(k)) for c in ("doc_id", "copy", "item_id")), pa.array(score), pa.array(at.astype(np.int64)), pa.array(length.astype(np.int64))], ["doc_id", "copy", "item_id", "score", "first_word", "n_words"])

    return run


def span_of(n: int, threshold: float) -> int:
    """Words of a document that an alignment over the threshold with an item of n words spans at most."""
    return n + max(0, int((1 - threshold) * MATCH * n / -max(MISMATCH, GAP) + 1e-9))


def _found(docs: DataFrame, benchmark: DataFrame, threshold: float, least_words: int) -> DataFrame:
    """(doc_id, copy, item_id, score, first_word, n_words); copy tells texts of one doc_id apart."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    docs = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    items = cut(_items(benchmark, threshold, least_words), "items")
    longest, hits = items.agg(F.max("n"), F.min("hits")).first()
    if longest is None:
        return docs.limit(0).select("doc_id", "copy", *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("score", "double"), ("first_word", "long"), ("n_words", "long"))))
    rare = cut(_rare(docs, items, cut(_item_seeds(items), "seeds")), "rare")
    windows = cut(_windows(docs, rare, span_of(longest, threshold), hits), "windows")
    place = ["doc_id", "copy", "start"]
    met = windows.select(*place, F.explode(F.arrays_zip("seeds", "at")).alias("s")).select(*place, F.col("s.seeds").alias("seed"), F.col("s.at").alias("place")).join(rare, "seed")
    met = met.groupBy(*place, "item").agg(F.sort_array(F.collect_set("place")).alias("at")).join(items.select("item", "n", "hits"), "item")
    reach = F.col("n") + F.floor(F.lit((1 - threshold) * MATCH / -max(MISMATCH, GAP)) * F.col("n") + 1e-9).cast("int")
    later = F.slice("at", F.col("hits"), F.greatest(F.size("at") - F.col("hits") + 1, F.lit(0)))
    met = met.where(F.size("at") >= F.col("hits")).where(F.exists(F.transform(later, lambda x, i: x - F.get("at", i)), lambda d: d < reach))
    met = cut(met.select(F.xxhash64(*place).alias("seed"), *(F.col(c).alias(f"_{c}") for c in place), "item", "at", "hits"), "met")
    both = _held(windows, met, place).join(items.select("item", "item_id", F.col("words").alias("own")), "item")
    return both.select(*place, "words", "at", "hits", "item_id", "own").mapInArrow(_aligned(threshold), "doc_id long, copy long, item_id long, score double, first_word long, n_words long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each document and benchmark item of which it holds a copy: doc_id, item_id, score, first_word, n_words.

    Score is the best local alignment over the item's length in words, 1 for an exact copy. Seeds are pairs of words that follow
    each other or have one word between them. Where an alignment scores `threshold` times the item's words n, at least threshold * n - 1
    of its matches follow another with one error or none between them, so each makes a pair that both texts have. So an item
    may leave out that many of its pairs less HITS, those that are commonest over all documents, and no alignment is lost: a copy
    still has HITS of the rare ones within the words that it can span. Documents are read twice: to count the pairs, and to
    give the words about HITS rare ones that stand close together. Those join the items by their seeds, a document and an item with HITS
    seeds in common within reach are aligned, and no text is sent. Tasks know the seeds by a filter of a fixed size, so any number of items will do.

    Items shorter than `least_words` can't be told from chance and match nothing. Null and empty texts have no words. Repeated rows,
    and different texts of one doc_id, report one row for each item: the highest score, of equal scores the last place. Items of equal
    item_id report as one.
    """
    best = _found(docs, benchmark, threshold, least_words).groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", "b.first_word", "b.n_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a copy of a benchmark item, by doc_id and text; rows without doc_id stay."""
    bad = _found(docs, benchmark, THRESHOLD, LEAST_WORDS).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_bad"), "copy").distinct()
    bad = cut(bad, "leaks")
    same = (docs["doc_id"].cast("long") == bad["_bad"]) & (F.xxhash64(docs["text"].cast("string")) == bad["copy"])
    return docs.join(bad, same, "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])
