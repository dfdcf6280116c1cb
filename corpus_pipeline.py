"""The corpus pipeline: language ID, near-duplicate removal, passage removal, mixing, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestream.llm.common import documents, materialize
from lodestream.llm.stages import keep_identified, keep_one_of_each, mix_sources, pack_sequences, remove_passages

STAGES = [
    ("language ID", keep_identified),
    ("n-gram Jaccard join", keep_one_of_each),
    ("suffix-array dedup", remove_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]
#: A string kernel's decisions and a tokenizer's ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over documents."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
