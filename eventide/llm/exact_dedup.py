"""Exact duplicates of whole texts, with frequent digests removed before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import SPACES
from eventide.session import materialize

#: A digest held by at least this share of the rows is treated as frequent.
SUPPORT = 1e-3


def _digest(text: Column) -> Column:
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, "").cast("binary"), 256)


def with_digest(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """All columns, and the SHA-256 of the text without white space as ``name``."""
    return docs.withColumn(name, _digest(F.col(text_col)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, code points and SHA-256 of the text without white space; a null text is empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("length"),
        _digest(F.col(text_col)).alias("digest"))


def frequent(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests of at least ``support`` of the rows, with the row that stays and the group's size.

    A Misra-Gries summary (``freqItems``) names at most ``1 / support`` candidates,
    among them every digest that is frequent; counting just those gives the
    verified winners. Both tables have at most ``1 / support`` rows.
    """
    total = rows.count()
    candidates = rows.freqItems(["digest"], support).select(
        F.explode("digest_freqItems").alias("digest"))
    return (rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(*_choice())
            .where(F.col("group_size") >= F.lit(support * total)))


def _choice() -> list:
    """Longest original text, then smallest id (a null id last), and the size of the group."""
    first = F.min(F.struct((-F.col("length")).alias("short"),
                           F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id")))
    return [first["id"].alias("keep_id"), F.count(F.lit(1)).alias("group_size")]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical without white space. Frequent
    digests are settled by a broadcast of at most ``1 / support`` winners in the
    map tasks; only the others are grouped by a shuffle, after map-side combining,
    and joined back by an equi-join that may be split.

    Null and empty texts are one group of empty texts. Rows that repeat an id stay
    rows of their own; all rows with the winner's id count as kept. A null id is
    kept only when every row of its longest texts lacks an id. Other columns are
    ignored. An empty table gives no rows.
    """
    rows = materialize(digests(docs, id_col, text_col), "digests")
    winners = materialize(frequent(rows, support).coalesce(1), "frequent-digests")  # at most 1 / support rows
    tagged = rows.join(F.broadcast(winners), "digest", "left")
    heavy = tagged.where("group_size IS NOT NULL")
    light = tagged.where("group_size IS NULL").select("doc_id", "length", "digest")
    rest = light.join(light.groupBy("digest").agg(*_choice()), "digest")
    columns = ["doc_id", "keep_id", "group_size",
               F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
               F.col("digest").alias("text_sha256")]
    return heavy.select(*columns).union(rest.select(*columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
"""
