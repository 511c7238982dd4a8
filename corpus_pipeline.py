"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, and any others that docs has, whatever their names.
An empty table gives an empty one at each stage. Repeated rows are judged alike. Long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosstide.llm import decontaminate, language_id, near_dups, packing, pii
from crosstide.llm.common import table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language can't be told: null texts, those without a letter, and those whose best
    language scores hardly better than chance. Where no two languages are labelled, only texts without a letter go.
    Null ids: judged like others."""
    return language_id.keep_known(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least id of each group of near copies: runs of five words, similarity of 0.8. Documents without words and
    rows without an id stay; so do all rows of an id that stays."""
    return near_dups.drop_near(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which any window of a benchmark item occurs: one leaked item is a leak. Null texts have
    no words and stay; an empty benchmark removes nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; no document goes. Null texts stay null."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length. Null texts are empty: one piece, the end id. Repeated rows: their pieces each."""
    return packing.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dups", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_pii),
    ("packing", packed),
]

#: Shingle hashes, a learnt model and a tokenizer are beyond SQL; tests hold a small table's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
