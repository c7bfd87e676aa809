"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_mod4, cut, fresh, ship
from .text import code_points, letters, pieces

#: n-grams of 1 to 3 lower-cased letters, words parted by one mark, hashed to so many buckets.
BUCKETS, ORDERS, SMOOTHING = 1 << 15, (1, 2, 3), 0.5
#: At most so many labelled rows of each language are learned from: those with the least hash of doc_id.
SAMPLE_ROWS = 1_000
#: Scores below it are rejected by keep_identified().
LEAST_SCORE = 0.5
UNKNOWN = "und"


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, row of each) of all n-grams, and whether each row has a letter: letters and their marks in lower case, all else is one mark between words."""
    points, offsets = code_points(data, offsets)
    low, letter, part = letters(points)
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    has = np.bincount(own[letter], minlength=len(offsets) - 1) > 0
    code = np.where(part, low, 32).astype(np.uint32)
    keep = np.ones(len(code), bool)
    keep[1:] = part[1:] | part[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    code, rows = code[keep], own[keep]
    out, of = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    h = np.zeros(len(code), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(code) - n + 1] * np.uint32(0x01000193) + code[n - 1 :] * np.uint32(0x9E3779B1)) if n > 1 else code * np.uint32(0x9E3779B1)
        if n in ORDERS and len(h):
            fits = rows[: len(h)] == rows[n - 1 :]
            mixed = h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x51ED27)
            mixed = mixed * np.uint32(0x85EBCA6B)
            out.append((mixed >> np.uint32(17))[fits])
            of.append(rows[: len(h)][fits])
    return np.concatenate(out), np.concatenate(of), has


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix of buckets by languages) from text and non-null lang.

    Per language at most `sample_rows` rows are learned from. How many rows a language has is sent to all tasks: one number for
    each language, of which the model holds BUCKETS. The counts of n-grams are added up on the executors, and what
    comes to the driver is BUCKETS numbers for each language."""
    from pyspark.sql.window import Window

    ship(docs.sparkSession)
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", F.col("lang").cast("string").alias("lang"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("_h"))
    counts = known.groupBy("lang").agg(F.count("*").alias("_n"))
    few = known.join(F.broadcast(counts), "lang").where(F.col("_h") < F.lit(float(1 << 40)) * 2 * (sample_rows + 8) / F.col("_n"))  # twice as many as wanted, about, whatever the language's size
    best = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    ids = cut(few.withColumn("_r", best).where(F.col("_r") <= sample_rows).select("doc_id").distinct(), "learned")
    sample = docs.where("lang IS NOT NULL AND text IS NOT NULL").join(ids, "doc_id", "left_semi").select("text", F.col("lang").cast("string").alias("lang"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for lo, hi, data, offsets in pieces(b.column("text")):
                g, rows, _ = _grams(data, offsets)
                for lang in set(langs[lo:hi]):
                    mine = np.array([x == lang for x in langs[lo:hi]])
                    c = np.bincount(g[mine[rows]], minlength=BUCKETS)
                    sums[lang] = sums.get(lang, 0) + c
        for lang, c in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([c.astype("<i8").tobytes()], pa.binary())], ["lang", "counts"])

    def total(t: pa.Table) -> pa.Table:
        c = sum(np.frombuffer(x, "<i8") for x in t.column("counts").to_pylist())
        return pa.table({"lang": t.column("lang").slice(0, 1), "counts": pa.array([c.tobytes()], pa.binary())})

    summed = sample.mapInArrow(run, "lang string, counts binary").groupBy("lang").applyInArrow(total, "lang string, counts binary").collect()
    langs = sorted(r["lang"] for r in summed)
    counts = np.array([np.frombuffer({r["lang"]: r["counts"] for r in summed}[x], "<i8") for x in langs], float).reshape(len(langs), BUCKETS)
    p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True) if langs else counts
    return langs, np.ascontiguousarray(np.log(p).T.astype(np.float32))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], names_out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs and two columns, named names_out: the language with the highest posterior, and that posterior.

    Every n-gram of the whole text counts; the posterior takes equal priors. A text that is null or has no letter (or any
    text where no language was learned) gives `und` and 0. Of languages with equal posteriors the first by name is given; repeated rows
    are predicted alike. The matrix goes to the executors once: BUCKETS numbers for
    each language."""
    ship(docs.sparkSession)
    langs = model[0]
    shared = docs.sparkSession.sparkContext.broadcast(model[1])
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            pred, score = [], []
            for lo, hi, data, offsets in pieces(b.column(at), 1 << 20):
                g, rows, letter = _grams(data, offsets)
                total = np.zeros((hi - lo, max(1, len(langs))))
                for k in range(len(langs)):
                    total[:, k] = np.bincount(rows, table[:, k][g], hi - lo)
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                for r in range(hi - lo):
                    has = bool(langs) and bool(letter[r])
                    pred.append(langs[best[r]] if has else UNKNOWN)
                    score.append(float(p[r, best[r]]) if has else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, *names_out])

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{names_out[0]}` string", f"`{names_out[1]}` double"])
    return docs.mapInArrow(run, fields)


def learned_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: those outside the held-out fold, whose crc32 of doc_id modulo 4 is 2."""
    return docs.where(crc32_mod4(F.col("doc_id")) != 2)


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without those in no known language: texts without letters, and scores under `least`."""
    model = train(learned_rows(docs))
    pred, score = own = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    return predict(docs, model, own).where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
