"""Best-fit packing with bound-certified repacking."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import cut, fresh, ship
from .tokens import tokenizer, with_end

CAPACITY = 4096
#: Pieces that a task packs at once, at most, and the share of all sequences that a round of exchange must save to be followed by another.
PIECES_AT_ONCE, LEAST_SAVED = 1 << 18, 1e-4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document: its place among the document's ids, its length and its checksum.

    A document is its ids and the end id; only one of more than `capacity` ids is cut. A null text is empty. Repeated rows give
    repeated pieces, and a null doc_id is kept. Texts are encoded whole, however long: one at a time beyond some MB."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, ids, bounds in tokenizer(vocabulary).encode(b.column(1)):
                ids, bounds = with_end(ids, bounds, end_id)
                lens = np.diff(bounds)
                per = -(-lens // capacity)
                row = np.repeat(np.arange(hi - lo), per)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * capacity
                length = np.minimum(capacity, lens[row] - start)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * s : 4 * (s + k)]) for s, k in zip((bounds[row] + start).tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + lo)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that pieces need at least; counts[x] pieces have length x.

    The best of two families of dual feasible functions: f(x) = C if x > C - k, 0 if x < k, else x; and
    f(x) = the share of the multiples of C / (k + 1) that x reaches over, rounded down where x is no such multiple."""
    x = np.arange(len(counts), dtype=np.int64)
    n = counts.astype(np.int64)
    total = int((n * x).sum())
    best = -(-total // capacity)
    below = np.concatenate([[0], np.cumsum(n * x)])
    many = np.concatenate([[0], np.cumsum(n)])
    k = np.arange(1, capacity // 2 + 1)
    big = (many[-1] - many[np.minimum(capacity - k + 1, len(counts))]) * capacity
    mid = below[np.minimum(capacity - k + 1, len(counts))] - below[np.minimum(k, len(counts))]
    best = max(best, int((-(-(big + mid) // capacity)).max(initial=0)))
    for k in range(1, 101):
        up = (k + 1) * x
        exact = up % capacity == 0
        f = np.where(exact, x * k, (up // capacity) * capacity)  # in units of C * k
        best = max(best, int(-(-int((n * f).sum()) // (capacity * k))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each piece, place in it, gap of each bin).

    Gaps are whole numbers up to `capacity`, so open bins wait in a list for each gap, and one big integer tells
    which lists hold any: the fullest bin that a piece fits is found by its lowest bit."""
    order = np.argsort(-lengths, kind="stable")
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    gaps: list[int] = []
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i, x in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> x
        if fits:
            gap = x + (fits & -fits).bit_length() - 1
            b = waiting[gap].pop()
            if not waiting[gap]:
                mask ^= 1 << gap
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = gap = gap - x
        if gap:
            waiting[gap].append(b)
            mask |= 1 << gap
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(gaps, np.int64)


@dataclass(frozen=True)
class Certificate:
    """Sequences that were made, and the number below which no packing of the same pieces can go."""

    sequences: int
    least: int


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items (with length, and doc_id and piece to tell them apart) and, for each, sequence_id and offset.

    Each task packs its pieces best-fit decreasing, PIECES_AT_ONCE together, and holds its number of bins against the lower
    bound of their lengths. Where they are equal it is certified and gives up only its emptiest bin; any other gives
    up all bins with gaps. What was given up is dealt out anew and packed again, until the total is the lower bound of all
    lengths, one task has packed all that is left, or a round has saved less than LEAST_SAVED of the sequences. The table that
    is returned has a Certificate in its attribute `certificate`, which tells how near to the bound it came. The
    pieces of a task are a few numbers each, and their order before packing follows from the rows alone, so a lost task
    gives the same again; equal lengths go by doc_id and piece. Pieces must have 1 to `capacity` ids. Columns sequence_id and offset that
    items has are replaced. An empty table gives no rows.
    """
    spark = items.sparkSession
    ship(spark)
    items = items.select(*[F.col(f"`{c}`") for c in items.columns if c.lower() not in ("sequence_id", "offset")])
    own = fresh(items, "settled")
    names = items.columns
    out_schema = StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField(own, BooleanType())])

    def packer(this_round: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            at = (this_round << 56) + (TaskContext.get().partitionId() << 34)

            def packed(got: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                nonlocal at
                t = pa.Table.from_batches(got).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
                lengths = t.column("length").to_numpy().astype(np.int64)
                bins, offsets, gaps = best_fit(lengths, capacity)
                certified = len(gaps) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
                give = gaps > 0
                if certified:
                    give = np.zeros(len(gaps), bool)
                    give[np.argmax(gaps)] = gaps.max() > 0
                t = t.append_column("sequence_id", pa.array(bins + at)).append_column("offset", pa.array(offsets)).append_column(own, pa.array(~give[bins]))
                at += len(gaps)
                yield from t.to_batches(max_chunksize=1 << 16)

            got: list[pa.RecordBatch] = []
            held = 0
            for b in batches:
                if len(b):
                    got.append(b)
                    held += len(b)
                if held >= PIECES_AT_ONCE:
                    yield from packed(got)
                    got, held = [], 0
            if got:
                yield from packed(got)

        return run

    counts = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    least = lower_bound(counts, capacity)
    done, rest = None, items
    settled, before, parts, k = 0, 0, 0, 0
    while True:
        if parts:
            rest = rest.repartition(parts, F.xxhash64("sequence_id", F.lit(k)))
        state = cut(rest.select(*names).mapInArrow(packer(k), out_schema), "packed")
        free = ~F.col(own)
        bins, loose, pieces_left = state.groupBy("sequence_id", own).agg(F.count("*").alias("n")).agg(F.count("*"), F.count_if(free), F.coalesce(F.sum(F.when(free, F.col("n"))), F.lit(0))).first()
        total = settled + bins
        stop = not loose or total <= least or parts == 1 or (k > 0 and before - bins <= LEAST_SAVED * total)
        kept = state if stop else state.where(F.col(own))
        done = kept if done is None else done.union(kept)
        if stop:
            break
        settled, before, rest = settled + bins - loose, loose, state.where(free)
        parts = -(-pieces_left // PIECES_AT_ONCE)
        k += 1
    out = done.select(*names, "sequence_id", "offset")
    out.certificate = Certificate(total, least)  # type: ignore[attr-defined]
    return out


__all__ = ["Certificate", "best_fit", "lower_bound", "pack", "pieces"]
