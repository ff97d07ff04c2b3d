"""A table of facts per entity, kept fresh by a stream of events.

The newest event time of every entity is keyed state in the state store, so a
batch writes only what it changes, and marks not seen for a while expire. A
batch recomputes the entities that advanced and replaces only the partitions of
the table they are in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

# A processor that may set timers always asks for one more batch; without data there is nothing to do here.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, as ``transformWithState`` requires."""
    before = {name: spark.conf.get(name) for name in _STATE_CONF}
    for name, value in _STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _marks(forget_ms: int | None) -> StatefulProcessor:
    """Holds an entity's newest time in microseconds and answers when it advances.

    The class is made here so that it travels to the workers whole, by value.
    """
    class Marks(StatefulProcessor):
        def init(self, handle) -> None:
            self.newest = handle.getValueState("newest", "newest long", forget_ms)

        def handleInputRows(self, key, rows, timerValues):
            seen = max(int(part["seen"].max()) for part in rows)
            held = int(self.newest.get()[0]) if self.newest.exists() else None
            # Written also when nothing advances: an entity that is still seen does not expire.
            self.newest.update((seen if held is None else max(seen, held),))
            if held is None or seen > held:
                yield pd.DataFrame({"key": [key[0]], "held": pd.array([held], "Int64"), "seen": [seen]})

        def close(self) -> None:
            pass

    return Marks()


def advances(stream: DataFrame, entity: str, time: str, forget_after: timedelta | None = None) -> DataFrame:
    """(entity, previous, current) of every batch's entities whose newest ``time`` advanced.

    An entity not seen for ``forget_after`` loses its mark; its next event counts as
    its first (``previous`` is null). Events without entity or time advance nothing.
    Each Arrow batch is reduced to one row per entity before the shuffle, so an entity
    with a third of all events sends one row per batch of them.
    """
    kind = stream.schema[entity].dataType
    arrived = T.StructType([T.StructField("key", kind), T.StructField("seen", T.LongType())])
    moved = T.StructType([arrived["key"], T.StructField("held", T.LongType()), arrived["seen"]])

    def reduced(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.groupby("key", as_index=False)["seen"].max()

    known = (stream.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
             .select(F.col(entity).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("seen"))
             .mapInPandas(reduced, arrived))
    forget_ms = None if forget_after is None else int(forget_after.total_seconds() * 1000)
    return (known.groupBy("key").transformWithStateInPandas(_marks(forget_ms), moved, "Update", "ProcessingTime")
            .select(F.col("key").alias(entity), F.timestamp_micros("held").alias("previous"),
                    F.timestamp_micros("seen").alias("current")))


def _bucket(entity: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(entity), F.lit(buckets)).cast("int")


def _staged_batch(spark: SparkSession, path: str) -> int | None:
    """The batch whose rows the stage holds in full; None if it holds none."""
    try:
        row = spark.read.schema("batch long").parquet(path).first()
    except AnalysisException:  # nothing staged yet
        return None
    return None if row is None else row.batch


def refresh_facts(stream: DataFrame, entity: str, time: str, path: str,
                  recompute: Callable[[DataFrame], DataFrame], buckets: int,
                  forget_after: timedelta | None = None) -> StreamingQuery:
    """Run over all files now available and keep the table of facts under ``path`` fresh.

    ``recompute`` receives a batch's advanced entities (entity, previous, current) and
    returns their rows, with the entity in its own column. The table is partitioned
    by a hash of the entity into ``buckets``, a number that stays for the table's life.
    ``refreshed_in`` names the batch a row comes from.

    A batch first stages the partitions it touches (untouched entities' rows carried
    over), then marks the stage as whole, then replaces those partitions from it. A
    batch replayed after a loss at any point either stages anew from the table, which
    was not yet changed, or replaces the partitions again from the same stage. The
    stage is overwritten by the next batch.
    """
    spark = stream.sparkSession
    table, stage, ready = f"{path}/table", f"{path}/stage", f"{path}/ready"
    moved = advances(stream, entity, time, forget_after)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        log = f"{path}/changed/batch={batch_id}"
        staged = _staged_batch(session, ready) == batch_id
        # Also when replayed: the state store takes a batch's marks as the batch is computed.
        batch.write.mode("overwrite").parquet(log)
        changed = session.read.schema(moved.schema).parquet(log)
        fresh = (recompute(changed).withColumn("refreshed_in", F.lit(batch_id).cast("long"))
                 .withColumn("_bucket", _bucket(entity, buckets)))
        if not staged:
            # A row without entity stands in every partition, so that one left empty is replaced too.
            touched = changed.select(_bucket(entity, buckets).alias("_bucket")).distinct()
            rows = fresh.unionByName(touched, allowMissingColumns=True)
            if batch_id > 0:
                held = session.read.schema(fresh.schema).parquet(table).where(F.col(entity).isNotNull())
                kept = (held.join(F.broadcast(touched), "_bucket", "left_semi")  # at most ``buckets`` rows
                        .join(changed.select(entity), entity, "left_anti"))
                rows = rows.unionByName(kept)
            (rows.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(stage))
            session.range(1).select(F.lit(batch_id).cast("long").alias("batch")).write.mode("overwrite").parquet(ready)
        (session.read.schema(fresh.schema).parquet(stage).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(table))

    with keyed_state(spark):
        return (moved.writeStream.outputMode("update").foreachBatch(per_batch)
                .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())


def read_facts(spark: SparkSession, path: str, entity: str) -> DataFrame:
    """The table of facts ``refresh_facts`` keeps under ``path``."""
    return spark.read.parquet(f"{path}/table").where(F.col(entity).isNotNull()).drop("_bucket")
