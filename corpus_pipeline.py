"""A training corpus from raw documents: clean, without near-duplicates, redacted, mixed and coded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspark.llm import mixing, pii, quality_rules, sentencepiece_codec, similar_documents
from polyspark.llm.common import free_prefix, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that fail the base rules or lose too much.

    A null or empty text has no word and goes; repeated rows are judged one by one; all columns stay, with ``text`` and ``n_chars`` renewed.
    """
    return (
        quality_rules.clean_lines(docs)
        .filter("kept")
        .withColumns({"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast("long")})
        .select(*docs.columns)
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the smallest id: op2's links (fingerprints within 3 bits) and those of words in fives with Jaccard 0.8 or more.

    Of rows of equal id and text one stays. A document without an id goes last; texts without a word are equal to each other.
    """
    return similar_documents.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind. A null text stays null; every row stays."""
    out = pii.annotate(docs, pii.fit(docs), redact=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights take it; rows of equal id and token count are taken together."""
    taken, copy = mixing.mix(docs).filter("copies > 0"), free_prefix(docs) + "copy"
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*docs.columns)


def coded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids, and whether decoding gives the text back. A null text has null ids."""
    out = sentencepiece_codec.encode(docs, check=True)
    return out.select("doc_id", "lang", "source", "n_pieces", "ids", "round_trip")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("pii", private_data),
    ("mixing", mixture),
    ("sentencepiece", coded),
]

#: Fingerprints, the random field and the coding have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
