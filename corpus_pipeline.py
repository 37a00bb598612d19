"""From raw documents to token blocks: five stages, each written as Parquet and read again by the next.

A stage decides by doc_id: rows that share an id go or stay together. Rows with a null id are judged by no filter and stay until the mix, which
takes them like all others. A null text counts as empty: not toxic, no copy of anything, no benchmark holder, no words to take. Ties are
broken by the smaller id. Further columns are kept whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from jobtide.llm.common import drop_rows, stored
from jobtide.llm.decontaminate import contained_items
from jobtide.llm.jaccard_join import jaccard_components
from jobtide.llm.mixing import mix_sources, take
from jobtide.llm.token_output import read_tokens, write_tokens
from jobtide.llm.toxicity import toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic. An id goes if one of its rows is toxic."""
    judged = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return drop_rows(docs, judged.where("toxic").select("doc_id"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the smallest doc_id."""
    groups = jaccard_components(docs)
    return drop_rows(docs, groups.where("doc_id <> component_id").select("doc_id"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. An id goes if one of its rows holds one."""
    held = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drop_rows(docs, held.select("doc_id").distinct())


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, not at all where that is zero; repeated rows are documents of their own."""
    return take(docs, mix_sources(docs))


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents written as token blocks, and what reading them back says of each."""
    return read_tokens(write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_output", token_blocks),
]
# The first, fourth and fifth stage have no SQL form: a fitted model, a sample and a code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
