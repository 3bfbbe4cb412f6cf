"""Pipeline stages: what operators decide, applied to tables of documents.

Filters keep all columns of their input as they are, whatever their names, and decide row by row, so
null and repeated ids make no difference to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, ngram_join, packing, toxicity
from quarry.llm.common import free_names, if_small, map_arrow, plain_names, stored, table


def _filtered(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs`` whose texts (null: empty) ``keep`` says to keep: list of texts -> list of bool."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep([t or "" for t in b.column(place).to_pylist()]), pa.bool_()))

    plain = plain_names(docs)
    return map_arrow(plain, run, plain.schema).toDF(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on those of them that have labels, doesn't reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held = spark.sparkContext.broadcast(model)
    return _filtered(docs, lambda texts: [held.value.probability(held.value.passages(t)[1]) < 0.5 for t in texts])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates; all columns as they are.

    Where rows repeat an id, each is judged by its own text: of those in one group, if it is the smallest
    id there, the least text stays; of rows that repeat id and text too, the least by their other columns'
    JSON text. Rows without id stay.
    """
    odd_id, own_id, fp, kept_fp, label, row, order = free_names(docs.columns, "odd_id", "own_id", "fp", "kept_fp", "label", "row", "order")
    classes = ngram_join.classified(docs).where("doc_id is not null")
    found = classes.groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias("first"), F.count(F.lit(1)).alias("rows"))
    odd = stored(found.where("not first or rows > 1"))
    odd = if_small(odd, odd.count())
    named = docs.withColumn(own_id, F.col("doc_id").cast("long"))
    whole = named.join(odd.select(F.col("doc_id").alias(odd_id)), F.col(own_id) == F.col(odd_id), "left_anti").drop(own_id)
    several = odd.where("first and rows > 1").select(F.col("doc_id").alias(odd_id))
    if several.isEmpty():
        return whole
    repeated = ngram_join.fingerprints(named.join(several, F.col(own_id) == F.col(odd_id), "left_semi"), fp)
    kept = classes.where("component_id = doc_id").select(F.col("doc_id").alias(odd_id), F.col("fp").alias(kept_fp), F.col("label").alias(label)).distinct()
    joined = repeated.join(kept, (F.col(own_id) == F.col(odd_id)) & (F.col(fp) == F.col(kept_fp)))
    columns = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    least = F.struct(F.coalesce("text", F.lit("")).alias("t"), F.to_json(F.struct(*[c.alias(f"c{k}") for k, c in enumerate(columns)])).alias("j"))
    one = joined.withColumn(order, least).groupBy(own_id, label).agg(F.min_by(F.struct(*columns), order).alias(row)).select(f"{row}.*")
    return whole.unionByName(one)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to edits."""
    for index in decontaminate.indexes(table(spark, sf_dir, "benchmark")):

        def clean(texts: list[str], index=index) -> list[bool]:
            hit = {m[0] for m in index.matches(texts)} if index.items else set()
            return [k not in hit for k in range(len(texts))]

        docs = _filtered(docs, clean)
    return docs


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of ``docs`` in sequences of 1024 tokens: ``pack_documents``, which ignores other columns."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
