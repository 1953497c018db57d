"""One query for each corpus operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, conversation_trie, exact_dedup, html_text, language_id, mixing, near_dedup, piece_bpe, secrets, substring_dedup, topk, warc
from .common import stage, table
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    merged = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat_ws(": ", e["key"], e["value"])), "; ")
    return found.select("record_id", "canonical_url", "ts", "outcome", "resolved_id", merged.alias("headers"), "digest")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.encode_decode(docs, BYTE_BPE, keep_text=False)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs, PIECES)
    found = language_id.identify(docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), model, drop_text=True)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "text_id")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.where(F.pmod("id", F.lit(100)) == 0), vectors, k=10)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html_text.extract(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.length("text").cast("long"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return report.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.fair_queue(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeats=3, share=1.0, seed=0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    turns = conversation_repair.damaged(conversations)
    plans = stage(conversation_repair.plan_repairs(turns), "plans")
    hashes = conversation_repair.digests(conversation_repair.repaired(turns, plans))
    out = conversations.select("conv_id").distinct().alias("c")
    for name, found in (("p", plans), ("h", hashes)):
        out = out.join(found.alias(name), F.col("c.conv_id").eqNullSafe(F.col(f"{name}.conv_id")), "left")
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in (*conversation_repair.COUNTS, "cost")]
    return out.select("c.conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = piece_bpe.encode_decode(docs, PIECE_BPE, keep_text=False)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.numbered(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.with_shared_heads(turns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_warc_revisits, op2_bpe, op3_language_id, op4_secret_scan, op5_near_dedup, op6_exact_topk, op7_html_text, op8_exact_dedup, op9_substring_dedup, op10_mixing, op11_conversation_repair, op12_piece_bpe, op13_conversation_trie)}
