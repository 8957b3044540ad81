"""A corpus pipeline of five operators; each stage's rows are written as Parquet and read again as the documents of the next one.

``run(spark, sf_dir)`` gives the packed pieces of the documents that every stage keeps.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedwork.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from deedwork.session import Tables, materialized


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a recognised language stay; a text without a letter has none. The column ``lang`` stays as it was given."""
    named = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # names that no column of the result has
    rows = docs.toDF(*named.values())
    held_out = F.crc32(F.col(named["doc_id"]).cast("string")) % 4 == 2
    told = language_id.identify(rows, held_out, named["doc_id"], named["text"], named["lang"], keep=tuple(named.values()))
    return told.where(F.col("lang_pred") != language_id.UNKNOWN).select(*(F.col(c).alias(name) for name, c in named.items()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents that are equal without white space stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates stays."""
    return near_dedup.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item stay."""
    return decontamination.clean_documents(docs, Tables(spark, sf_dir).benchmark)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, as pieces of full sequences."""
    path = public_tokenizers.path
    return packing.pack(docs, str(path("byte_bpe_50k.json")), str(path("byte_bpe_50k.tiktoken")))


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("decontaminated", decontaminated),
    ("packed", packed),
]

#: Model scores, alignments and token ids are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
