import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagelake.llm import packing, simple8b, token_files, tokens
from pagelake.llm.common import scratch
from pagelake.llm.queries import vocabulary
from pagelake.llm.tokens import BulkTokenizer

ODD = ["", None, "it's we'll 's'll ''s  a  b \n\n x\n\ty  ", "don'T DON'T  \n", "a\n b", "1234 12ab a1b2", "'", "x'", "'r", "'re", "'rx", "naïve ÀÉß œuvre", "日本 words", "<|endoftext|> hi", "  ", "ab\r\n\r\ncd !!'s !'s", "é'sé", "á b", "x\x0by"]


def library(name):
    t = Tokenizer.from_file(vocabulary(name))
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_bulk_equals_library(name):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab '\n s1Lltrev!.É é") for _ in range(rng.randrange(0, 14))) for _ in range(3000)]
    own, t = BulkTokenizer(vocabulary(name)), library(name)
    got = []
    for lo, hi, ids, bounds in own.encode(pa.array(texts, pa.string())):
        got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(hi - lo)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("clashing", [False, True])
def test_words_are_told_apart(monkeypatch, name, clashing):
    monkeypatch.setattr(tokens, "WORDS_AT_ONCE", 50)
    if clashing:  # all words under a few hashes
        monkeypatch.setattr(tokens, "mix", lambda h: h % np.uint64(7) + np.uint64(1))
    rng = random.Random(2)
    texts = ["abcdefghZZabcdefgh abcdefghYYabcdefgh abcdefghabcdefgh abcdefgabcdefgh", "a" * 9 + " " + "a" * 10 + " " + "a" * 17 + " " + "a" * 40, "x " * 300]
    texts += [" ".join("".join(rng.choice("abé") for _ in range(rng.randrange(1, 30))) for _ in range(60)) for _ in range(20)]
    own, t = BulkTokenizer(vocabulary(name)), library(name)
    for _ in range(2):
        got = []
        for lo, hi, ids, bounds in own.encode(pa.array(texts, pa.string())):
            got += [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(hi - lo)]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]
        texts = texts[::-1]


def test_table_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "WORDS_AT_ONCE", 1000)
    monkeypatch.setattr(tokens, "FULL", 2000)  # reached within the text
    own, t = BulkTokenizer(vocabulary("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    text = " ".join(f"{i:x}q" for i in range(5000))
    for _ in range(2):
        (_, _, ids, _) = next(own.encode(pa.array([text])))
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids and own.used <= 2000


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    cases = [np.zeros(0), np.zeros(700), rng.integers(0, 2, 1000), np.array([2**64 - 1, 2**60, 1 << 59, 1, 2**60 - 1, 0, 1 << 60] * 100, np.uint64), rng.integers(0, 50257, 10000), np.arange(257), np.array([1 << 63, 1 << 60])]
    for ids in cases:
        ids = ids.astype(np.uint64)
        out, starts = simple8b.encode(ids)
        assert (simple8b.decode(out, starts.astype(np.int64), len(ids)) == ids).all()
        names = [None, 5]
        assert simple8b.read_segment(simple8b.pack_segment(names, np.array([len(ids), 0]), ids))[2].tolist() == ids.tolist()


def test_files_read_back(spark):
    rows = [(7, "some text here", 1), (3, None, 1), (None, "lost", 1), (5, "", 1), (4, "word " * 50_000, 1), (7, "some text here", 1), (-2, "日本", 1)]
    path = scratch(spark, "t")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string, start int"), path, vocabulary("byte_bpe_50k.json"), 2)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    t = library("byte_bpe_50k.json")
    at = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(ordered)
    for r, (doc, text, _) in zip(got, ordered, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    empty = scratch(spark, "t")
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), empty, vocabulary("byte_bpe_50k.json"), 2)
    assert token_files.read(spark, empty).count() == 0


def test_pieces_and_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["cat", "dog", "zebra"]) for _ in range(rng.randrange(0, 3000)))) for i in range(60)] + [(100, "long " * 9000), (101, None), (None, "no id"), (100, "long " * 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = packing.pack(packing.pieces(docs, vocabulary("word_bpe_49k.json"), 1)).collect()
    t = library("word_bpe_49k.json")
    want = []
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            p = ids[k : k + 4096]
            want.append((doc, k // 4096, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
    key = lambda x: (x[0] is None, x)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    check_sequences(got, 4096)
    total = sum(w[3] for w in want)
    assert len({r["sequence_id"] for r in got}) <= -(-total // 4096) * 1.1 + 1
    assert packing.pack(packing.pieces(spark.createDataFrame([], "doc_id long, text string"), vocabulary("word_bpe_49k.json"), 1)).count() == 0


def test_packing_some_pieces_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_AT_ONCE", 40)
    rng = random.Random(5)
    rows = [(k % 300, k // 300, 0, rng.choice([rng.randrange(1, 101), rng.randrange(30, 60)]), 1, 5, 7) for k in range(700)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, settled int, offset long, Sequence_ID int").repartition(2)
    packed = packing.pack(items, 100)
    assert packed.columns == ["doc_id", "piece", "start", "length", "settled", "sequence_id", "offset"]
    got = packed.collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in got) == sorted((r[0], r[1], r[3]) for r in rows)
    check_sequences(got, 100)
    made = len({r["sequence_id"] for r in got})
    assert packed.certificate.sequences == made >= packed.certificate.least >= sum(r[3] for r in rows) / 100
    assert made <= packed.certificate.least * 1.05


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        bins, offsets, gaps = packing.best_fit(lengths, 100)
        assert packing.lower_bound(np.bincount(lengths, minlength=101), 100) <= len(gaps)
        assert all(lengths[bins == b].sum() + gaps[b] == 100 for b in range(len(gaps)))
    assert packing.lower_bound(np.bincount([51] * 7, minlength=101), 100) == 7
    assert packing.lower_bound(np.bincount([34] * 9, minlength=101), 100) == 5
