"""A corpus pipeline over documents: each stage takes (spark, docs, sf_dir), and the next one gets what it kept.

Defined cases, in every stage: an empty table gives an empty result; further
columns are carried along under any name (`doc_id`, `text`, `lang` and `source`
are the only ones read, the last stage returns its own three); texts of any
length are handled whole. Documents are decided by id: rows that share one
(null is an id of its own) go or stay together, and stay if one of them does.
What a null or an empty text, a tie or a repeated row leads to is told by each
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import common, exact_dedup, language, mixing, pieces, simhash

#: A document whose likeliest language has a lower mean probability is rejected.
LEAST_SCORE = 0.3


#: Ids (8 bytes each, 8 MB in all) up to which those that go are broadcast; beyond, documents and ids meet in a shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs, in its columns, but for those whose id (null included) has no kept row in decided(doc_id, kept)."""
    own = common.unused(docs, "gone_id")
    gone = decided.groupBy(F.col("doc_id").alias(own)).agg(F.bool_or("kept").alias("kept")).where("not kept").select(own)
    gone = common.bounded_broadcast(common.written(gone, "gone"), BROADCAST_IDS)
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; `und` and uncertain ones go. Learns from the documents it gets.

    A null or empty text and one without a letter go; a null `lang` is not learned from; each row is judged by itself, so
    repeated rows stay together; without any `lang` all documents go.
    """
    network = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return language.keep_known(docs, network, least_score=LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id.

    A null text equals an empty one; a null id is smaller than any; rows with one id and equal texts all stay.
    """
    return _without(docs, exact_dedup.exact_groups(docs).select("doc_id", "kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group, the document with the smallest id.

    Null, empty and wordless texts have fingerprint zero and form one group; rows without an id go where their group has
    a row with one and stay otherwise.
    """
    groups = simhash.near_duplicates(docs)
    return _without(docs, groups.select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null source is a source of its own; a text without words is taken 0 times and goes; rows with one id are all taken
    as often as the one taken most.
    """
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids) of each document; a null or empty text has no ids; repeated rows stay."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the network nor the fingerprints; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
