"""The queries of this package, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import chat, decontaminate, ngram_join, packing, sharding, sstable, topk, toxicity, transducer, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_top_k": topk.op2_top_k,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_sstable": sstable.op4_sstable,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_url_filters": urls.op6_url_filters,
    "op7_token_counts": transducer.op7_token_counts,
    "op8_packing": packing.op8_packing,
    "op9_sharding": sharding.op9_sharding,
    "op10_decontamination": decontaminate.op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op2_top_k": topk.OP2_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op6_url_filters": urls.OP6_SQL,
}
