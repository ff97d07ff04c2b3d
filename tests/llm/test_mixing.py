import math
from collections import defaultdict

import pytest

from eventide.llm import queries
from eventide.llm.mixing import Target, mix_sources, passes, weigh


def exponent_by_bisection(tokens, target):
    """Plain bisection on the definition."""
    tokens = [t for t in tokens if t > 0]
    total = sum(tokens)

    def weights(x):
        raised = [(t / total) ** x for t in tokens]
        return [r / sum(raised) for r in raised]

    def entropy_ok(x):
        return -sum(w * math.log(w) for w in weights(x)) >= target.entropy * math.log(len(tokens)) - 1e-12

    def repeats_ok(x):
        return max(w * target.budget * total / t for w, t in zip(weights(x), tokens)) <= target.repeats

    def border(ok, rising):
        lo, hi = 0.0, 1.0
        if rising and ok(0.0):
            return 0.0
        if not rising and ok(1.0):
            return 1.0
        if not rising and not ok(0.0):
            return 0.0
        for _ in range(100):
            mid = (lo + hi) / 2
            if ok(mid) == rising:
                hi = mid
            else:
                lo = mid
        return hi

    return max(border(entropy_ok, False), border(repeats_ok, True))


def made():
    rows, i = [], 0
    for source, docs in (("big", 400), ("mid", 80), ("small", 10), (None, 30), ("s", 5)):
        for _ in range(docs):
            rows.append((i, " ".join(["w"] * (1 + i * 7 % 23)), source, i))
            i += 1
    return rows + [(9000, None, "mid", 0), (9001, "", "empty", 0), (None, "a b", "small", 0), (3, "w w", "big", 1)]


SCHEMA = "doc_id long, text string, source string, epoch int"


@pytest.mark.parametrize("target", [Target(block_docs=16), Target(entropy=0.8, repeats=2.0, block_docs=16),
                                    Target(entropy=0.99, repeats=50.0, budget=1.7, block_docs=7)])
def test_weights_and_budgets(spark, target):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plan, exponent = passes(weigh(df), target)
    tokens = defaultdict(int)
    docs = defaultdict(list)
    for d, text, s, _ in rows:
        tokens[s] += len((text or "").split())
        docs[s].append((d, len((text or "").split())))
    want = exponent_by_bisection(tokens.values(), target)
    assert exponent == pytest.approx(want, abs=1e-7)
    total = sum(tokens.values())
    norm = sum((t / total) ** want for t in tokens.values() if t)
    got = defaultdict(list)
    for r in mix_sources(df, target).collect():
        got[r.source].append(r)
    for s, t in tokens.items():
        if not t:
            assert s not in got
            continue
        budget = (t / total) ** want / norm * target.budget * total
        whole = int(budget / t + 1e-9)
        for e in range(whole):
            assert sorted((str(r.doc_id), r.n_tokens) for r in got[s] if r.epoch == e) == sorted((str(d), n) for d, n in docs[s])
        part = [r for r in got[s] if r.epoch == whole]
        assert all(r.epoch <= whole for r in got[s])
        taken = sum(r.n_tokens for r in part)
        longest = max(n for _, n in docs[s])
        assert taken <= budget - whole * t + 1e-6 and taken > budget - whole * t - 2 * longest
        # what is taken comes first in the order of the pass
        assert len({(r.block_order) for r in got[s] if r.epoch == 0}) <= -(-len(docs[s]) // target.block_docs)


def test_passes_are_different_permutations(spark):
    df = spark.createDataFrame(made(), SCHEMA)
    rows = [r for r in mix_sources(df, Target(entropy=1.0, repeats=3.0, block_docs=4)).collect() if r.source == "small"]
    order = [[r.doc_id for r in sorted(rows, key=lambda r: (r.block_order, r.doc_order)) if r.epoch == e] for e in (0, 1)]
    assert order[0] != order[1] and sorted(map(str, order[0])) == sorted(map(str, order[1]))


def test_empty_table_and_no_tokens(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix_sources(spark.createDataFrame([(1, None, None, 0), (2, " ", "a", 0)], SCHEMA)).count() == 0


def test_query_on_driver_table(spark, sf_dir):
    got = queries.op7_mix_sources(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = weigh(docs).agg({"n_tokens": "sum"}).first()[0]
    assert abs(got.n_tokens.sum() / total - 1) < 0.5
    assert not got.duplicated(["doc_id", "epoch"]).any()
