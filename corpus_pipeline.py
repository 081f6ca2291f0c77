"""A training-data pipeline of five stages over ``documents``.

Language identification drops what no language claims, exact dedup and near-dedup keep one document
of each group, mixing puts the rest in the order of the target weights (the order of the written
rows), and encoding turns every text into ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import exact_dedup, language_id, mixing, probminhash, queries, sentencepiece_codec


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are ``und``: null, or without any letter. Columns of any name stay as they are."""
    model = language_id.train(docs.filter(~queries.fold(3, 1)))
    if not model.languages:  # nothing is labelled: no language can be named, but texts with letters stay
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    names = tuple(
        next(
            n for n in (name, *(f"{name}_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns
        ) for name in ("lang_pred", "lang_score")
    )
    return language_id.predict(docs, model, names=names).filter(F.col(names[0]) != language_id.UND).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return probminhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs, queries.PIECE_MODEL, carry=["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("probminhash", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: No SQL: the suffix automata, ProbMinHash and the tokenizer cannot be said in it. tests/llm holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
