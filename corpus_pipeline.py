"""A training corpus from raw documents: quality rules, exact and near duplicates, secrets, packing.

Each stage takes the documents its predecessor kept, as read back from Parquet, and returns documents of the same columns;
the last returns the packed pieces. Rows are told apart by a running number, so rows with equal or null ids are each
decided for themselves; the numbered table is written once, as a number that were computed again could fall on another row.
Null texts fail the quality rules, empty tables pass through empty.

A stage's result must be written before the next stage is called, as ``run`` does: a stage begins by removing the tables
that the stage before it has cut.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilwork.llm import common
from veilwork.llm.exact_dedup import exact_dedup
from veilwork.llm.ngram_join import ngram_join
from veilwork.llm.packing import pack
from veilwork.llm.quality import quality
from veilwork.llm.secrets import redact, secret_scan

ROW = "_row_of_stage"
#: Folders of the tables that the last stage has cut.
_CUT: list[str] = []


def _stage(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.drop(spark, _CUT)
        with common.collecting(_CUT):
            return stage(spark, docs, sf_dir)

    return begun


def _numbered(docs: DataFrame) -> DataFrame:
    return common.cut(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _keeping(docs: DataFrame, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    return rows.join(wanted.select(ROW), ROW, "left_semi").select(*docs.columns)


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a certified cutoff rejects."""
    rows = _numbered(docs)
    return _keeping(docs, rows, quality(rows, common.labels(spark, sf_dir), row_col=ROW).where("kept"))


@_stage
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays, then the least id, then the first row."""
    rows = _numbered(docs)
    return _keeping(docs, rows, exact_dedup(rows, row_col=ROW).where("kept"))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the least id stays; documents without words are in none and stay."""
    rows = _numbered(docs)
    found = common.cut(ngram_join(rows, row_col=ROW))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col(ROW))).alias("least")
    first = found.where(F.col("component").isNotNull()).groupBy("component").agg(least).select(F.col(f"least.{ROW}").alias(ROW))
    return _keeping(docs, rows, first.union(found.where(F.col("component").isNull()).select(ROW)))


@_stage
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced in the text."""
    rows = _numbered(docs)
    found = secret_scan(rows, row_col=ROW).where(F.size("found") > 0).select(F.col("row").alias(ROW), F.col("found").alias("_spans_of_stage"))
    joined = rows.join(found, ROW, "left")
    text = F.when(F.col("_spans_of_stage").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("_spans_of_stage")))
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return pack(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_duplicates), ("n-gram Jaccard join", near_duplicates), ("secret scans", secrets), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each cut from its predecessor by a written table."""
    docs, read = common.documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        written: list[str] = []
        with common.collecting(written):
            docs = common.cut(kept)
        common.drop(spark, read)
        read = written
    return STAGES[-1][1](spark, docs, sf_dir)
