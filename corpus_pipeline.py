"""A corpus pipeline of five operators; each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.llm.decontamination import find_contamination
from gaugeflow.llm.line_dedup import dedup_lines
from gaugeflow.llm.near_dedup import group_near_duplicates
from gaugeflow.llm.packed import staged, table
from gaugeflow.llm.packing import pack
from gaugeflow.llm.quality import fit, score_quality
from gaugeflow.session import tune


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network trained on the labelled ones of them doesn't reject."""
    network = fit(docs, table(spark, sf_dir, "labels"), "quality")
    return score_quality(docs, network, threshold=0.5).where("predicted = 1").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them repeat."""
    return dedup_lines(docs).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and documents without an id."""
    lost = group_near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all kept documents and their places in training sequences."""
    return pack(docs, size=1024, end=2)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
