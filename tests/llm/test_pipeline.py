"""The pipeline against a plain version of its stages, on the smallest tables."""

import zlib

import corpus_pipeline
import numpy as np
from test_filters import SF, normal, smith_waterman
from test_simhash import brute as simhash_brute
from test_suffix_dedup import brute as repeats_brute
from test_tokens import check_sequences, library

from pagelake.llm import decontaminate


def test_like_plain_stages(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if any(c.isalpha() for c in t or "")}
    _, root = simhash_brute(list(docs.items()))
    docs = {d: t for d, t in docs.items() if root[d] == d}
    gone = repeats_brute(docs)
    left = {d: [w for i, w in enumerate(t.split()) if i not in gone.get(d, ())] for d, t in docs.items()}
    docs = {d: w for d, w in left.items() if w or d not in gone}

    def leaks(words):
        own = normal(" ".join(words))
        return any(set(i) & set(own) and smith_waterman(i, own) / len(i) >= decontaminate.THRESHOLD for i in items)

    clean = {d: w for d, w in docs.items() if not leaks(w)}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(clean)
    check_sequences(rows, 4096)
    t = library("word_bpe_49k.json")
    first = {r["doc_id"]: r for r in rows if r["piece"] == 0}
    for d, w in clean.items():  # words that met where a passage was cut out may stand side by side in the text
        ids = [*t.encode(" ".join(w), add_special_tokens=False).ids, 1]
        if d not in gone:
            assert first[d]["ids_crc32"] == zlib.crc32(np.array(ids[:4096], "<u4").tobytes())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(40), SF).columns == docs.columns
