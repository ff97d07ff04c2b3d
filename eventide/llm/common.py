"""Helpers shared by the corpus operators: reading, hashing in tasks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.session import materialize

#: The white space that separates words in every contract of this folder.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, mod: int, rest: int = 2) -> Column:
    """Whether crc32 of the id's digits leaves ``rest``; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "numbered") -> DataFrame:
    """Rows with ``pos`` (long, from 0, by ``order`` among equal ``group``) and ``size`` (rows of the group).

    The rows are sorted by ranges of group and order, so a group of any size is dealt over as
    many tasks as it needs, and rows that are equal in all of these by a stored random number.
    Only the number of rows of each (group, range) is summed along a group. Group columns must
    not be null; nulls of the order come first.
    """
    keys = [*group, *order, "_salt"]
    salted = materialize(rows.withColumn("_salt", F.rand()), f"{name}-salted")
    placed = materialize(salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_salt")
                         .withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    along = Window.partitionBy(*group)
    before = along.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
              .select(*group, "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                      F.sum("_rows").over(along).alias("size")))
    return (placed.join(starts, [*group, "_range"]).withColumn("pos", F.col("_at") + F.col("_shift"))
            .select(*rows.columns, "pos", "size"))


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column, nulls as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def hash_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the usual shift-multiply finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Order-dependent 64-bit hashes of all runs of ``width`` word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = mix(out + words[i:i + n] + np.uint64(0x9E3779B97F4A7C15))
    return out


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal keys, one table each, from batches sorted by the keys."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        tagged = list(zip(*columns, strict=True))
        cuts = [0, *(i for i in range(1, len(tagged)) if tagged[i] != tagged[i - 1]), len(tagged)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = pa.table(batch.slice(a, b - a))
            if held and tagged[a] != held_key:
                yield pa.concat_tables(held)
                held = []
            held.append(piece)
            held_key = tagged[a]
    if held:
        yield pa.concat_tables(held)


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected edge table (a, b).

    Every round passes the smallest label over the edges and then follows the
    label of the label, so long chains shrink fast. Labels live in written
    tables; the loop ends when no label changes. Nodes without edges have no row.
    """
    both = materialize(
        edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(), f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("node"))
                         .agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    for _ in range(rounds):
        heard = (both.join(labels.withColumnRenamed("node", "b"), "b")
                 .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard")))
        nearer = labels.join(heard, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        step = materialize(
            nearer.join(roots, "label", "left")
            .select("node", "old", F.least("label", F.coalesce("root", "label")).alias("label")),
            f"{name}-labels")
        if step.where("label <> old").isEmpty():
            return step.select("node", "label")
        labels = step.select("node", "label")
    raise RuntimeError("labels still change; raise rounds")
