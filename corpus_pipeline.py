"""A corpus pipeline over the table documents: STAGES, each written as Parquet and read again for the next.

A null or empty text has no letters, so language ID drops it; rows without doc_id pass near-dedup, suffix-array dedup and
decontamination as they are, as no group, span or leak can be told for them. Texts of one doc_id that differ are judged apart. Other
columns pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelake.llm import decontaminate, language_id, packing, simhash, suffix_dedup
from pagelake.llm.common import clear_scratch, cut, scratch_paths


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters or with a low score go."""
    return language_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier in the corpus."""
    return suffix_dedup.remove_repeats(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without copies of benchmark items."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the sequences that they are packed into."""
    return packing.pack(cut(packing.pieces(docs, "word_bpe_49k.json", 1), "pieces"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", deduplicate),
    ("suffix_dedup", remove_repeats),
    ("decontamination", decontaminate_benchmark),
    ("packing", pack),
]

#: Fingerprints, suffix order, alignment and packing can't be told in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has written besides its result is deleted when that stands, and so is its predecessor's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = scratch_paths()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
            clear_scratch(spark, [p for p in scratch_paths() if p not in before and p != docs.scratch_path])
    return docs
