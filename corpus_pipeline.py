"""From raw documents to packed training sequences.

``STAGES`` run in order. Each takes all documents that the one before it kept and returns them with the columns of the
documents table, further columns included; the last returns the packed pieces. An empty table gives an empty result in
every stage. Null texts count as empty. Null doc_ids are rows like any other and come after all others where order counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetlens.llm import exact_dedup, mixing, packing, shingles, simhash_dedup, toxicity
from sheetlens.llm.common import keep_rows, materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go. Empty texts are clean; repeated rows go or stay together; without
    labels of both values all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.fit(docs, labels))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the document with the largest doc_id stays, and of repeated rows one.
    Empty texts are equal to each other."""
    found = exact_dedup.exact_duplicates(docs)
    return keep_rows(docs, found.where("kept").select("doc_id", "raw_sha256"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component that links of fingerprints and pairs of 5-word Jaccard 0.8 or more join together.
    It's the one with the smallest doc_id, then text hash; repeated rows count once. Texts without words have one
    fingerprint, so one of them stays."""
    return keep_rows(docs, shingles.representatives(docs, materialize(simhash_dedup.groups(docs))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights of sources, languages and topics, as near as the documents allow. Null
    sources and languages are values of their own; repeated rows share the decision."""
    return mixing.mix(docs).where("mix_sampled").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of bounded length, a row for each piece; repeated rows are packed as often as they come."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_duplicates),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Trained models, components and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
