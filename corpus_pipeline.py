"""From raw documents to a tokenised training mix, stage by stage.

Every stage works on all rows its predecessor kept. An id names a document: rows
that repeat an id stay or go together, except that of equal rows exact_dedup leaves
one. Null ids are one such name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import bpe
from eventide.llm.common import table
from eventide.llm.exact_dedup import exact_dedup, with_digest
from eventide.llm.language_id import UNDETERMINED, language_id
from eventide.llm.mixing import mix_sources
from eventide.llm.near_dedup import near_components
from eventide.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MIN_SCORE = 0.4  # a document whose largest language has less is rejected
NEAR_PERCENT = 80  # documents of at least this similarity are near copies


def _named(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """With the id as a string key that null ids share."""
    return df.withColumn("_name", F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    names = _named(kept.select("doc_id")).select("_name").distinct()
    return _named(docs).join(names, "_name", "left_semi").drop("_name")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a leading language go."""
    return _only(docs, language_id(docs).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= MIN_SCORE)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row that exact_dedup keeps stays, the longest if its id is repeated."""
    kept = _named(exact_dedup(docs).where("kept")).select("_name", F.col("text_sha256").alias("_digest")).distinct()
    rows = _named(with_digest(docs, "_digest")).join(kept, ["_digest", "_name"], "left_semi")
    row = F.struct(*docs.columns)
    return rows.groupBy("_digest", "_name").agg(F.max_by(row, F.struct(F.length("text"), "text")).alias("row")).select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return _only(docs, near_components(docs, percent=NEAR_PERCENT).where("kept"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture draws it."""
    drawn = _named(mix_sources(docs)).groupBy("_name", "epoch").count().groupBy("_name").agg(F.count(F.lit(1)).cast("int").alias("_copies"))
    return (_named(docs).join(drawn, "_name").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
            .select(*docs.columns))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every drawn document, and the digest of the bytes they decode to."""
    vocabulary = bpe.ranks()
    return bpe.encode(docs, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(bpe.decode(F.col("ids"), vocabulary), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: SQL has no counterpart of language inference, signatures and merges; the stages are
#: tested against brute-force versions instead.
ORACLE_SQL = None
