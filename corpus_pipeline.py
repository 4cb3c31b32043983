"""A corpus pipeline over `documents`: five stages, each written and read again.

Stages keep all columns of `documents` but the last; further columns stay as they are,
whatever their names. Null and empty texts: the language stage rejects texts without a
letter. Rows with a null or repeated doc_id are documents like others: each text's group of near
copies keeps one row, and the mix takes each by its own. Repeated rows are near copies of each other.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import bpe, langid, mix, simhash, toxicity
from cadenza.llm.queries import tokenizer_path
from cadenza.llm.shared import Scratch, passing_scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear."""
    return langid.identify(docs, langid.learn(docs), keep=True)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not count as toxic; labels of the corpus teach the score."""
    field = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.tag(docs, field, keep=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them."""
    return mix.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix."""
    return bpe.encode_and_decode(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Compression, a trained field and BPE can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Each stage's table is in the shared folder until the next one is written there."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        stored = Scratch(spark, f"pipeline-stage{k}")
        with passing_scratch():
            docs = stored.put(stage(spark, docs, sf_dir), "rows", keep=True)
        if last is not None:
            last.delete()
        last = stored
    return docs
