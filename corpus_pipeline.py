"""Corpus pipeline: documents -> toxicity -> quality rules -> near-dedup -> source mixture -> token ids.

Each stage takes all its predecessor kept and its decisions take effect: the first three drop rows,
the fourth repeats rows of small sources, the last encodes what is left and decodes it again. Stages but the last return
the columns of ``documents``. ``run`` writes each stage, the last too, to the folder that driver and executors share
and reads it again, so a lost executor costs one stage at most; a stage's folder goes once the next is written. What is left
is the product, the token ids of each use of a document, in the folder ``bpe``.

Defined results: null and empty texts have no words, so the quality rules drop them; rows equal in id and text, and
repeated texts under other ids, leave one row at near_dedup; of rows that repeat an id with unrelated texts all stay;
a null id is no bar to any stage; a null source is a source of its own; extra columns stay until the last stage;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearby.llm import bpe, mixing, quality_rules, simhash, toxicity
from nearby.llm.common import new_folder, remove_folder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.drop_failed(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.remix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, digests of ids and decoded text, and the ids themselves, for each use of a document."""
    return bpe.round_trip(docs, keep=("doc_id", "source"), ids="ids")


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("near_dedup", drop_near_duplicates), ("source_mixture", mix_sources), ("bpe", encode)]

#: No stage's rows can be had in SQL from the tables alone (learned weights, 64-bit XXH hashes, merges).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, old = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline"), ""
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if old:
            remove_folder(spark, old)
        old = f"{folder}/{name}"
    return docs
