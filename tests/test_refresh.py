"""Facts kept fresh by a stream: keyed state, replaced partitions, replays, expiry."""

import datetime as dt
import time
from datetime import timedelta

from pyspark.sql import functions as F

from eventide.streaming import incremental as inc
from eventide.streaming import refresh as ref

T = dt.datetime
SCHEMA = "entity string, ts timestamp, extra int"


class Feed:
    """Events arriving in files, and the facts as they stand at each batch."""

    def __init__(self, spark, base, forget_after=None):
        self.spark, self.base, self.src, self.forget_after = spark, f"{base}/out", f"{base}/src", forget_after
        self.calls, self.fail = [], False

    def arrive(self, rows):
        self.spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(self.src)

    def run(self):
        def recompute(changed):
            facts = self.spark.read.schema(SCHEMA).parquet(self.src)
            out = inc.refresh_changed(changed, facts, "entity", lambda f: f.groupBy("entity").agg(
                F.count(F.lit(1)).alias("n")))
            self.calls.append(sorted(r.entity for r in changed.collect()))
            if self.fail:
                raise RuntimeError("lost")
            return out.where("entity <> 'gone'")
        stream = self.spark.readStream.schema(SCHEMA).parquet(self.src)
        ref.refresh_facts(stream, "entity", "ts", self.base, recompute, 4, self.forget_after).awaitTermination()

    def table(self):
        return {r.entity: (r.n, r.refreshed_in) for r in ref.read_facts(self.spark, self.base, "entity").collect()}


def test_only_advanced_entities_are_recomputed(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.arrive([("a", T(2024, 1, 1)), ("a", T(2024, 1, 3)), ("b", T(2024, 1, 2)), (None, T(2024, 1, 1)), ("n", None)])
    feed.run()
    assert feed.table() == {"a": (2, 0), "b": (1, 0)}
    feed.arrive([("a", T(2024, 1, 2)), ("b", T(2024, 1, 9)), ("c", T(2024, 1, 1))])  # a: late, advances nothing
    feed.run()
    want = {"a": (2, 0), "b": (2, 1), "c": (1, 1)}
    assert feed.table() == want and feed.calls[-1] == ["b", "c"]
    feed.arrive([("b", T(2024, 1, 9)), ("c", T(2024, 1, 1))])  # delivered again
    feed.run()
    assert feed.table() == want and feed.calls[-1] == []
    feed.run()  # nothing arrived
    assert len(feed.calls) == 3
    moved = {(r.batch, r.entity): (r.previous, r.current) for r in spark.read.parquet(f"{feed.base}/changed").collect()}
    assert moved[(1, "b")] == (T(2024, 1, 2), T(2024, 1, 9)) and moved[(1, "c")][0] is None


def test_facts_match_a_plain_recount_over_many_entities(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    want, newest, seen = {}, {}, {}
    for b in range(3):
        rows = [(f"e{i * i % 23}", T(2024, 1, 1) + timedelta(hours=(i * 37 + b * 11) % 90)) for i in range(b, 60, b + 1)]
        feed.arrive(rows)
        feed.run()
        for e, _ in rows:
            seen[e] = seen.get(e, 0) + 1
        for e in {e for e, _ in rows}:
            top = max(t for x, t in rows if x == e)
            if e not in newest or top > newest[e]:
                newest[e], want[e] = top, (seen[e], b)
        assert feed.table() == want


def test_a_batch_cut_off_anywhere_is_made_good_by_its_replay(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.arrive([("a", T(2024, 1, 1)), ("b", T(2024, 1, 1)), ("d", T(2024, 1, 1))])
    feed.run()
    feed.arrive([("a", T(2024, 2, 1)), ("c", T(2024, 2, 1))])
    feed.fail = True
    try:
        feed.run()
    except Exception:  # the batch failed before it staged anything
        pass
    assert feed.table() == {"a": (1, 0), "b": (1, 0), "d": (1, 0)}
    feed.fail = False
    feed.run()
    want = {"a": (2, 1), "b": (1, 0), "c": (1, 1), "d": (1, 0)}
    assert feed.table() == want
    for mark in ("1", ".1.crc"):  # as if cut off after staging, before the commit
        (tmp_path / "out" / "checkpoint" / "commits" / mark).unlink()
    part = spark.read.parquet(f"{feed.base}/table").where("entity is null")
    part.limit(0).write.mode("overwrite").partitionBy("_bucket").parquet(f"{feed.base}/table")  # partitions lost meanwhile
    feed.run()
    replaced = {e: v for e, v in want.items() if v[1] == 1}
    assert replaced.items() <= feed.table().items() and feed.table().items() <= want.items()


def test_an_entity_without_facts_leaves_the_table(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    feed.arrive([("gone", T(2024, 1, 1))])
    feed.run()
    assert feed.table() == {}
    feed.arrive([("a", T(2024, 1, 1)), ("gone", T(2024, 1, 5))])
    feed.run()
    assert feed.table() == {"a": (1, 1)}


def test_marks_not_seen_for_a_while_expire(spark, tmp_path):
    feed = Feed(spark, tmp_path, timedelta(seconds=1))
    feed.arrive([("a", T(2024, 1, 5))])
    feed.run()
    time.sleep(1.5)
    feed.arrive([("a", T(2024, 1, 1))])
    feed.run()
    moved = {r.batch: r.previous for r in spark.read.parquet(f"{feed.base}/changed").collect()}
    assert moved == {0: None, 1: None} and feed.table() == {"a": (2, 1)}
