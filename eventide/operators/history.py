"""Trailing arrays without a wide window.

A series is cut into blocks of n rows and every block carries its predecessor,
so the last n values up to any row are a filter of one block: one equi-join
per lookup instead of a window that rebuilds an n-row list at every row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions import rolling as R


def trailing_arrays(probes: DataFrame, rows: DataFrame, key: str, seq: str, value: str, n: int,
                    out: str) -> DataFrame:
    """Add ``out``: values of rows (seq - n, seq] of the probe's series, oldest first.

    ``rows`` is dense in ``seq`` per key; null values stay in the array.
    """
    block = lambda c: F.floor(F.col(c) / n).alias("_block")
    blocks = (rows.groupBy(key, block(seq))
              .agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"),
                                                        F.col(value).alias("v")))).alias("_own")))
    w = R.series(key, "_block")
    before = F.coalesce(F.lag("_own").over(w), F.filter("_own", lambda x: F.lit(False)))
    paired = blocks.select(key, "_block", F.concat(before, F.col("_own")).alias("_both"))
    at = F.col(seq)
    recent = F.filter("_both", lambda x: (x.s > at - n) & (x.s <= at))
    return (probes.withColumn("_block", block(seq))
            .join(paired, [key, "_block"])
            .withColumn(out, F.transform(recent, lambda x: x.v))
            .drop("_block", "_both"))
