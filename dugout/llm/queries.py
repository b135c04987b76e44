"""The queries of this subpackage, each over its whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dugout.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    filter_audit,
    hard_negatives,
    jaccard_join,
    order_minhash,
    packing,
    sharding,
    string_kernel,
    token_counts,
    url_filters,
    warc,
)
from dugout.llm.oracles import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = byte_bpe.round_trip(_table(spark, sf_dir, "documents"), path, pattern)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"), width=4, threshold=jaccard_join.Threshold(85, 100))


#: Fixed rules of the query.
URL_RULES = [
    url_filters.Rule("block", "net", "/"),
    url_filters.Rule("allow", "example.net", "/en/"),
    url_filters.Rule("block", "example.com", "/de/"),
    url_filters.Rule("allow", "org", "/fr/"),
]


def op3_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judged(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    archives = warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = string_kernel.learnable(_table(spark, sf_dir, "labels"))
    scores = string_kernel.scored(_table(spark, sf_dir, "documents"), labels, carry=["doc_id"])
    return scores.select("doc_id", string_kernel.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    markers = "</s>[INST] ok [/INST]"
    own = spark.sql(
        f"select cast(-7 as bigint) conv_id, cast(turn as bigint) turn, role, '{markers}' text from values (0, 'user'), (1, 'assistant') as t(turn, role)"
    )
    messages = stored.unionAll(own).select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    read = chat_format.read_back(chat_format.format_chats(messages))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op9_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.interleave(rows, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(_table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(hard_negatives.relabelled(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_url_redirects": op3_url_redirects,
    "op4_warc_dictionary": op4_warc_dictionary,
    "op5_string_kernel": op5_string_kernel,
    "op6_chat_parts": op6_chat_parts,
    "op7_token_counts": op7_token_counts,
    "op8_wu_manber": op8_wu_manber,
    "op9_stratified_shards": op9_stratified_shards,
    "op10_order_minhash": op10_order_minhash,
    "op11_packing": op11_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}
