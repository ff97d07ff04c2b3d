"""Incremental jobs on Structured Streaming.

State and results are written per micro-batch into folders named by the batch
id, so a batch that is replayed after a failure overwrites its own output and
nothing is counted twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def latest_per_entity(events: DataFrame, entity: str, time: str) -> DataFrame:
    return events.groupBy(entity).agg(F.max(time).alias("latest"))


def new_events(events: DataFrame, state: DataFrame, entity: str, time: str) -> DataFrame:
    """Entities whose newest event is later than their stored mark, or that have none.

    ``state`` has (entity, latest). Columns: entity, previous, current.
    """
    seen = latest_per_entity(events, entity, time)
    held = state.select(entity, F.col("latest").alias("previous"))
    return (seen.join(held, entity, "left")
            .where(F.col("previous").isNull() | (F.col("latest") > F.col("previous")))
            .select(entity, "previous", F.col("latest").alias("current")))


def advanced_state(state: DataFrame, fresh: DataFrame, entity: str) -> DataFrame:
    both = state.select(entity, "latest").unionByName(
        fresh.select(entity, F.col("current").alias("latest")))
    return both.groupBy(entity).agg(F.max("latest").alias("latest"))


def _state_before(spark: SparkSession, path: str, batch: int, schema: T.StructType) -> DataFrame:
    """State as the preceding batch left it; empty for the first batch."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={batch - 1}")


def detect_new_events(stream: DataFrame, entity: str, time: str, state_path: str, out_path: str,
                      checkpoint: str, on_new: Callable[[DataFrame, int], None] | None = None,
                      ) -> StreamingQuery:
    """Run over all files now available: report new events per batch and move the marks.

    ``on_new`` may act on each batch's changed entities, for instance to
    recompute only their facts (``refresh_changed``).
    """
    schema = T.StructType([stream.schema[entity], T.StructField("latest", stream.schema[time].dataType)])

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = _state_before(spark, state_path, batch_id, schema)
        target = f"{out_path}/batch={batch_id}"
        new_events(batch, state, entity, time).write.mode("overwrite").parquet(target)
        fresh = spark.read.parquet(target)
        advanced_state(state, fresh, entity).write.mode("overwrite").parquet(
            f"{state_path}/batch={batch_id}")
        if on_new is not None:
            on_new(fresh, batch_id)

    return (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def without_redelivered(stream: DataFrame, id_column: str, time: str,
                        delay: str = "1 day") -> DataFrame:
    """Drop events delivered again within the delay; state older than it is forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([id_column])


def refresh_changed(changed: DataFrame, facts: DataFrame, entity: str,
                    recompute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``recompute`` over the facts of changed entities only."""
    return recompute(facts.join(changed.select(entity).distinct(), entity, "left_semi"))


def stale_series(prices: DataFrame, key: str, today: str, max_age_days: int = 2) -> DataFrame:
    """Series whose newest price is older than the allowed age plus a long weekend."""
    cutoff = F.date_sub(F.lit(today).cast("date"), max_age_days + 4)
    return (prices.groupBy(key).agg(F.max("date").alias("last_date"))
            .where(F.col("last_date") < cutoff))


def content_changed(before: DataFrame, after: DataFrame, time: str) -> DataFrame:
    """One row: whether row count or newest timestamp differ between two versions of a table."""
    def sign(df: DataFrame):
        return df.agg(F.struct(F.count(F.lit(1)).alias("n"), F.max(time).alias("t"))).scalar()
    one = before.sparkSession.range(1)
    return one.select((~sign(before).eqNullSafe(sign(after))).alias("changed"))


def digest(new: DataFrame, scores: DataFrame, watched: DataFrame, top: int = 10) -> DataFrame:
    """Rows of a cycle's digest: counts, then the strongest current scores."""
    counts = (watched.agg(F.count(F.lit(1)).alias("value")).select(
        F.lit("watched").alias("item"), F.col("value").cast("double"))
        .unionByName(new.agg(F.count(F.lit(1)).alias("value")).select(
            F.lit("new_events").alias("item"), F.col("value").cast("double"))))
    best = (scores.where(F.col("predicted_signal") > 0)
            .orderBy(F.col("predicted_signal").desc(), "sample_id").limit(top)
            .select(F.col("sample_id").alias("item"), F.col("predicted_signal").alias("value")))
    return counts.unionByName(best)


def newest_scores(scores: DataFrame, entity: str, time: str) -> DataFrame:
    """Each entity's score of its latest ``time``; the smallest sample id among equals."""
    rest = [c for c in scores.columns if c != entity]
    first = F.min_by(F.struct(*rest), F.struct((-F.unix_date(F.col(time).cast("date"))).alias("age"), "sample_id"))
    return scores.groupBy(entity).agg(first.alias("_s")).select(entity, "_s.*")


def digest_cycles(stream: DataFrame, entity: str, time: str, path: str, scores: Callable[[], DataFrame],
                  watched: DataFrame, top: int = 10) -> StreamingQuery:
    """One cycle over all files now available: detect new events, then write the batch's digest.

    ``scores`` is asked in every batch, so a digest shows the scores of its own time. The
    digest of batch b is the folder ``digest/batch=b``: a batch run again replaces it.
    """
    def write(fresh: DataFrame, batch_id: int) -> None:
        digest(fresh, scores(), watched, top).write.mode("overwrite").parquet(f"{path}/digest/batch={batch_id}")

    return detect_new_events(stream, entity, time, f"{path}/state", f"{path}/new", f"{path}/checkpoint", write)
