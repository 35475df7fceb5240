"""From raw documents to token ids: each stage applies one operator to all rows.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
documents it keeps, all columns included. What a stage decides takes effect: rejected
documents and copies go, documents the mix takes more than once come as often, the one at
a source's cut is shortened. The last stage returns the token ids in place of the texts.
``run`` writes every stage as a table on the shared folder and goes on from it.

From the third stage on, rows are told apart by id and text; the second leaves none that
share both.

Defined results: a document without text (NULL, empty, spaces) has too few words and is
rejected; of equal texts, and of near copies, the smallest id stays, NULL ids last; rows that
share an id but not a text are documents of their own; further columns, whatever their names,
are kept by all stages but the last; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.llm import bpe, exact, mixing, near, quality
from sweepframe.llm.queries import vocabulary
from sweepframe.session import write_table


def keep_good(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents that the quality policy keeps."""
    return quality.accepted(docs, policy="v2")


def drop_copies(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Of documents with the same text up to spaces, the one with the smallest id."""
    return exact.distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Of documents connected by five-word similarity of 0.8 or more, the one with the smallest id."""
    return near.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents as often and as far as the mix of their sources takes them."""
    return mixing.mixed(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Token ids in place of the texts, with digests of the ids and what they decode to."""
    return bpe.encoded(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("exact duplicates", drop_copies),
    ("near duplicates", drop_near_copies),
    ("source mix", mix_sources),
    ("token ids", encode),
]

#: The near-duplicate stage needs a hash and the last stage a tokenizer that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf), "pipeline").df
    return STAGES[-1][1](spark, docs, sf)
