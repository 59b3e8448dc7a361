"""The corpus pipeline: documents to packed training sequences.

Stages run in order on Parquet tables; each works on all rows its predecessor
kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, mixing, packing, simhash, toxicity
from plumbline.llm.common import prepare, read_table
from plumbline.llm.queries import BYTE_BPE
from plumbline.session import settle

#: No SQL: two stages apply a model and a tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights; copies share their ``doc_id``."""
    return mixing.mix(docs, mixing.repetition_rates(docs)).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, BYTE_BPE).drop("ids")


def _stage(fn):
    @functools.wraps(fn)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, docs, sf_dir)

    return stage


STAGES = [
    ("toxicity", _stage(drop_toxic)),
    ("exact_dedup", _stage(drop_exact_copies)),
    ("simhash_near_dedup", _stage(drop_near_copies)),
    ("source_mixing", _stage(mix_sources)),
    ("best_fit_packing", _stage(pack_sequences)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
