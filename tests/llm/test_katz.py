import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from eventide.llm import katz, queries
from eventide.llm.katz import CUT, discounts, score_texts


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


class Model:
    """The definition, with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.count, self.after = order, [Counter() for _ in range(order + 1)], [None] + [defaultdict(set) for _ in range(order)]
        for t in texts:
            w = [b"<s>"] * (order - 1) + tokens(t)
            for i in range(order - 1, len(w)):
                for k in range(1, order + 1):
                    g = tuple(w[i - k + 1:i + 1])
                    self.count[k][g] += 1
                    self.after[k][g[:-1]].add(g[-1])
        self.n = sum(self.count[1].values())
        self.v = len(self.count[1])
        self.d = [None] + [discounts([sum(c == r for c in self.count[k].values()) for r in range(1, CUT + 2)]) for k in range(1, order + 1)]
        self.memo = {}

    def kept(self, k, g):
        c = self.count[k][g]
        return c * self.d[k][min(c, CUT + 1)]

    def history(self, k, h):
        """What counts are divided by, and the weight of the lower order."""
        if (k, h) not in self.memo:
            seen = self.after[k].get(h, ())
            total = sum(self.count[k][h + (w,)] for w in seen)
            kept = sum(self.kept(k, h + (w,)) for w in seen)
            whole = total if total - kept > 1e-9 * total else total + 1
            if k == 1:
                weight = 1 - kept / whole
            else:
                weight = (1 - kept / whole) / (1 - sum(self.p(h[1:] + (w,)) for w in seen)) if seen else 1.0
            self.memo[k, h] = whole, weight
        return self.memo[k, h]

    def p(self, g):
        k = len(g)
        whole, weight = self.history(k, g[:-1])
        if self.count[k][g]:
            return self.kept(k, g) / whole
        return weight if k == 1 else weight * self.p(g[1:])

    def score(self, text):
        w = [b"<s>"] * (self.order - 1) + tokens(text)
        return sum(math.log10(self.p(tuple(w[i - self.order + 1:i + 1]))) for i in range(self.order - 1, len(w)))

    def base(self, text):
        return sum(math.log10((self.count[1][(t,)] + 1) / (self.n + self.v + 1)) for t in tokens(text))


def made(seed, words=60):
    rng = random.Random(seed)
    names = [f"W{i}" for i in range(words)]
    chance = [1 / (i + 1) for i in range(words)]
    rows = [(i, " ".join(rng.choices(names, chance, k=rng.randint(0, 60)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "never seen É é"), (None, "w1 w2 never"), (103, "w1 " * 30_000), rows[3], rows[3], (4, "w5 other")]
    return [(*r, i % 5 == 0) for i, r in enumerate(rows)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_the_definition(spark, order):
    rows = made(order)
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, held boolean, words int").repartition(3)
    model = Model([t for _, t, h in rows if not h], order)
    want = sorted(((str(d), h, len(tokens(t)), sum((w,) in model.count[1] for w in tokens(t)), model.n, model.base(t), model.score(t))
                   for d, t, h in rows), key=str)
    got = sorted(((str(r[0]), *r[1:]) for r in score_texts(df, order=order).collect()), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: (x[:5], round(x[5], 4))), sorted(want, key=lambda x: (x[:5], round(x[5], 4))), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


def test_the_model_sums_to_one():
    rows = made(9)
    model = Model([t for _, t, _ in rows], 2)
    words = [g[0] for g in model.count[1]]
    for h in [(b"<s>",), (b"w1",), (b"w40",), (b"never",)]:
        total = sum(model.p(h + (w,)) for w in words) + model.p(h + (b"unseen word",))
        assert total == pytest.approx(1, abs=1e-9)


def test_nothing_learned_and_empty_table(spark):
    schema = "doc_id long, text string, held boolean"
    got = score_texts(spark.createDataFrame([(1, "a b", True)], schema)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(3, 0, 0)] and math.isfinite(got[0].score)
    assert score_texts(spark.createDataFrame([], schema)).count() == 0


def test_more_blocks_give_the_same(spark):
    rows = made(5)
    df = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    one = score_texts(df.coalesce(1)).collect()
    many = score_texts(df.repartition(16)).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in one) == sorted((str(r.doc_id), round(r.score, 6)) for r in many)


def test_query_on_driver_table(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    model = Model([t for d, t in rows if not held[d]], katz.ORDER)
    got = {r.doc_id: r for r in queries.op6_katz_scores(spark, sf_dir).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d], len(tokens(t)), model.n)
        assert r.base_score == pytest.approx(model.base(t), rel=1e-9) and r.score == pytest.approx(model.score(t), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
