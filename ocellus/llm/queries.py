"""Queries ``opN_<name>``: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.llm import chat_format, decontaminate, html_text, jaccard_join, license_scan, oracles, packing, quality_model, quality_rules, token_store, url_filter
from ocellus.llm._arrow import written
from ocellus.workers import importable

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(url_filter.labelled_by_rules(pages)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.table_turns(table(spark, sf_dir, "conversations"))
    said = "</s>[INST] ok [/INST]"
    record = spark.range(1).select(F.lit(-1).alias("conv_id"), F.to_json(F.struct(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(said).alias("content")) for r in ("user", "assistant")]).alias("messages"))).alias("record"))
    back = chat_format.read_back(chat_format.format_chats(turns.unionByName(chat_format.record_turns(record, "conv_id", "record"))))
    digest = lambda parts: F.sha2(F.concat_ws("", parts).cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))).alias("turns_sha256"),
        F.char_length(F.concat_ws("", "loss_texts")).cast("long").alias("loss_chars"), digest(F.col("loss_texts")).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = written(quality_rules.measured(table(spark, sf_dir, "documents")))
    return quality_rules.judge(seen, quality_rules.cutoffs(seen, table(spark, sf_dir, "labels")))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=1)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_url_filter, op3_quality, op4_chat_format, op5_quality_rules, op6_token_store, op7_html_text, op8_jaccard_join, op9_packing, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
