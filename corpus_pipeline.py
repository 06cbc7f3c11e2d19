"""The corpus pipeline: five stages over ``documents``, each written and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.decontaminate import without_contaminated
from quantloom.llm.jaccard import jaccard_components, one_of_each
from quantloom.llm.mixing import mix
from quantloom.llm.pii import find_personal_data, redact
from quantloom.llm.quality import accepted, fit_quality
from quantloom.llm.queries import QUALITY_CUT, table
from quantloom.llm.storage import held_out, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like others; repeated rows alike. Without labels all stay or go by the score of the
    share of label 1. An empty table gives an empty one. Long texts are scored whole; columns come back as they were.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return accepted(docs, model, QUALITY_CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, and one row of it.

    Word-less texts are near no other; of rows without an id one of each set of shingles stays. An empty table gives an
    empty one. Long texts count whole; columns come back as they were.
    """
    return one_of_each(docs, materialise(jaccard_components(docs), "components"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts stay; repeated rows stay or go together. An empty table gives an empty one. Long texts are
    searched whole; columns come back as they were.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts are generalised; ``n_chars`` follows the new text.

    Null texts stay null; repeated rows get equal texts. An empty table gives an empty one. Long texts are searched
    whole; other columns come back as they were.
    """
    out = redact(find_personal_data(docs.withColumnsRenamed({c: f"kept_{c}" for c in docs.columns if c.startswith("pii_")})))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(F.col(f"`kept_{c}`").alias(c) if c.startswith("pii_") else F.col(f"`{c}`") for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies.

    Null and word-less texts are taken 0 times; repeated rows are drawn one by one. An empty table gives an empty one.
    Columns named as the mix's own are replaced.
    """
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mixing", mixing),
]

#: The stages are not expressible in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
