"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from vacantia.llm import (
    decontaminate, fertility, licenses, mixing, neardup, passages, preferences, token_alignment, token_files, turn_repair, url_trie,
    vector_search, warc_bundles,
)
from vacantia.llm.common import table
from vacantia.session import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op2_chained_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.shared_passages(table(spark, folder, "documents"))


def op3_edit_matches(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), out, WORD_BPE, end_id=1)
    return token_files.read_documents(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


def op5_weighted_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), least_idf=neardup.WHOLE_IDF).drop("node", "class_key")


def op6_license_spans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_documents(table(spark, folder, "documents")).withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op7_tokenizer_fertility(spark: SparkSession, folder: str) -> DataFrame:
    return fertility.judge(table(spark, folder, "documents"), PIECE_BPE)


def op8_url_trie(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_trie.RULES), "host string, path string, verdict string")
    return url_trie.judge(table(spark, folder, "pages"), rules)


def op9_preference_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return preferences.preference_rows(preferences.swapped_replies(table(spark, folder, "conversations")))


def op10_warc_bundles(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "warc")
    records = warc_bundles.read_records(warc_bundles.write_bundles(table(spark, folder, "pages"), out), out)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_block_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.nearest(table(spark, folder, "embeddings"), vector_search.every_nth())


def op12_diagonal_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align_documents(table(spark, folder, "documents"), BYTE_BPE, PIECE_BPE)


def op13_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_chained_passages": op2_chained_passages,
    "op3_edit_matches": op3_edit_matches,
    "op4_token_files": op4_token_files,
    "op5_weighted_minhash": op5_weighted_minhash,
    "op6_license_spans": op6_license_spans,
    "op7_tokenizer_fertility": op7_tokenizer_fertility,
    "op8_url_trie": op8_url_trie,
    "op9_preference_pairs": op9_preference_pairs,
    "op10_warc_bundles": op10_warc_bundles,
    "op11_block_neighbours": op11_block_neighbours,
    "op12_diagonal_alignment": op12_diagonal_alignment,
    "op13_turn_repair": op13_turn_repair,
}
ORACLES = {
    "op1_source_mix": mixing.SQL.replace("{documents}", "documents"),
    "op8_url_trie": url_trie.SQL,
    "op9_preference_pairs": preferences.SQL,
    "op10_warc_bundles": warc_bundles.SQL,
    "op11_block_neighbours": vector_search.SQL,
}
