"""The registered queries of the corpus operators, over whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    conversation_repair,
    exact_dedup,
    html_text,
    language_id,
    mixing,
    packing,
    prefix_trie,
    simhash,
    token_counts,
    token_files,
    topk,
    toxicity,
    warc,
)
from plumbline.llm.common import prepare, read_table
from plumbline.llm.tokenizing import TokenizerFile
from plumbline.session import new_table_path

BYTE_BPE = TokenizerFile(public_tokenizers.path("byte_bpe_50k.json"), words="spaced")
WORD_BPE = TokenizerFile(public_tokenizers.path("word_bpe_49k.json"), words="separate", lower=True)

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    @functools.wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return fn(spark, folder)

    LLM_QUERIES[fn.__name__] = run
    return run


@query
def op1_best_fit_packing(spark, folder):
    return packing.packed_documents(read_table(spark, folder, "documents"), BYTE_BPE).drop("ids")


@query
def op2_exact_top_k(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    return topk.top_k(vectors, F.col("id") % 20 == 0, k=20)


@query
def op3_token_files(spark, folder):
    path = new_table_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, folder, "documents"), path, WORD_BPE)
    return token_files.read_token_files(spark, path).drop("ids")


@query
def op4_toxicity(spark, folder):
    return toxicity.toxicity_scores(
        read_table(spark, folder, "documents"), read_table(spark, folder, "labels")
    )


@query
def op5_source_mixing(spark, folder):
    docs = read_table(spark, folder, "documents")
    return mixing.mix(docs, mixing.repetition_rates(docs))


@query
def op6_simhash_near_dedup(spark, folder):
    return simhash.near_duplicate_classes(read_table(spark, folder, "documents")).select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"
    )


@query
def op7_token_counts(spark, folder):
    docs = read_table(spark, folder, "documents")
    return token_counts.suffix_sums(token_counts.length_histogram(docs, BYTE_BPE))


@query
def op8_html_extraction(spark, folder):
    return html_text.page_texts(read_table(spark, folder, "pages"))


@query
def op9_warc(spark, folder):
    path = new_table_path(spark, "warc")
    warc.write_warc(read_table(spark, folder, "pages"), path)
    return warc.page_records(spark, path)


@query
def op10_exact_dedup(spark, folder):
    return exact_dedup.duplicate_groups(read_table(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


@query
def op11_language_id(spark, folder):
    return language_id.document_languages(read_table(spark, folder, "documents"))


@query
def op12_conversation_repair(spark, folder):
    return conversation_repair.repaired_conversations(read_table(spark, folder, "conversations"))


@query
def op13_prefix_trie(spark, folder):
    return prefix_trie.conversation_trie(read_table(spark, folder, "conversations"))
