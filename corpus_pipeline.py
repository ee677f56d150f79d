"""The corpus pipeline: quality rules, near duplicates, benchmark decontamination, source mix, token files.

Each stage gets what the one before it kept, and its decisions take effect on the documents. All stages but the last return
the columns of documents. Between stages the documents are written and read again.

Defined results: a null or empty text has no words, so the quality rules reject it and no later stage sees it; of rows with equal
texts one stays, the one with the smallest doc_id (null ids last); ties of the mix are spread by a hash, so reruns agree; an empty
table passes all stages and gives no rows; extra columns, whatever their names, are carried through all stages but the last and
change no decision; long texts count whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import decontaminate, fertility, mixing, neardup, token_files
from vacantia.llm.common import table, written
from vacantia.llm.queries import PIECE_BPE, WORD_BPE
from vacantia.session import scratch_path

END_ID = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility and repetition rules keep."""
    return fertility.kept_documents(docs, PIECE_BPE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id."""
    return neardup.one_per_class(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens, ids_crc32, shard."""
    out = scratch_path(spark, "token-files")
    token_files.write_token_files(docs, out, WORD_BPE, END_ID)
    return token_files.read_documents(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL can tokenise or draw weighted samples; tests hold the stages against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
