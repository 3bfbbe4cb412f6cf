"""From raw documents to packed training sequences: each stage's table is written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import stages
from quarry.llm.common import stored, table

#: (name, function of spark, docs and sf_dir); all but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.reject_toxic),
    ("ngram_join", stages.one_of_each_group),
    ("decontamination", stages.without_benchmark),
    ("packing", stages.packed),
]

#: SQL can express none of the four; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), codec="zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
