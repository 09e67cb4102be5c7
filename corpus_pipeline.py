"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing and packing, each stage written and read again.

Mixing decides the order of the rows in the files that it writes; packing takes documents in that order, packs those
together that stand near each other, and names sequences by their first place. So the sequences in order of their ids
follow the mix.

Each stage takes null ids, texts, languages and sources, repeated rows, empty tables and columns of any other names; what
it does with them is stated in its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bucketloom.llm import exact_dedup, mixing, near_dedup, packing, quality
from bucketloom.llm.common import documents, stash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.kept_rows(docs, k=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The language model and the tokenizer cannot be expressed in SQL; tests/llm/test_pipeline.py holds run() and the
#: stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, name.replace(" ", "-"))
    return docs
