import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from eventide.llm import queries, substring_dedup
from eventide.llm.substring_dedup import minima, remove_repeats, run_hashes, super_kmers


def brute(rows):
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ä", "|"]

    def some(n):
        return [rng.choice(words) for _ in range(n)]

    shared = [some(n) for n in (20, 34, 35, 36, 60, 200)]
    rows = [(1, None), (2, ""), (3, " \n "), (4, " ".join(some(34))), (5, "a " * 300), (6, "b c " * 60), (7, " ".join(some(30) * 3))]
    for i in range(60):
        body = some(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            body += rng.choice(shared) + some(rng.randint(0, 50))
        rows.append((100 + i, rng.choice([" ", "\n", "\t "]).join(body)))
    rows += [(500, rows[20][1]), (500, rows[21][1]), (None, rows[22][1]), (None, rows[23][1]), (600, " ".join(some(60_000)))]
    return rows + [rows[10], rows[10]]


@pytest.mark.parametrize(("seed", "hot"), [(1, 2000), (2, 2000), (3, 8)])
def test_against_brute_force(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)  # the small value splits buckets by window
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, uid long, key string").repartition(3)
    assert sorted(map(tuple, substring_dedup.substring_dedup(df).collect()), key=str) == brute(rows)


def test_super_kmers_cover_every_window_once():
    rng = random.Random(4)
    texts = [[b"%d" % rng.randrange(9) for _ in range(n)] for n in (0, 34, 35, 90, 400)]
    text, start, n, _, sid = super_kmers(texts)
    got = sorted((t, s + k) for t, s, m in zip(text, start, n) for k in range(m))
    assert got == [(t, i) for t, w in enumerate(texts) for i in range(len(w) - 34)]


def test_run_hashes_name_the_words():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 2**63, 500, np.uint64)
    words[300:400] = words[100:200]
    starts, lengths = np.array([100, 300, 100, 101, 301, 0]), np.array([60, 60, 61, 60, 60, 500])
    got = run_hashes(words, starts, lengths)
    assert got[0] == got[1] and got[3] == got[4] and len(set(got.tolist())) == 4


def test_minima():
    x = np.random.default_rng(1).integers(0, 50, 200).astype(np.uint64)
    assert minima(x, 31).tolist() == [x[i:i + 31].min() for i in range(170)]
    assert len(minima(x[:30], 31)) == 0


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_driver_table(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = sorted(map(tuple, queries.op4_substring_dedup(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
    assert sum(r[2] for r in got) > 0


def test_no_group_holds_a_hot_bucket(spark, monkeypatch):
    """A passage that every document holds amid text of its own."""
    monkeypatch.setattr(substring_dedup, "HOT", 8)
    real = substring_dedup._count

    def bounded(batches):
        held = list(batches)
        names = [c for c in ("key", "sub") if held and c in held[0].schema.names]
        sizes = Counter(k for b in held for k in zip(*(b.column(c).to_pylist() for c in names)))
        assert max(sizes.values(), default=0) <= 8
        yield from real(iter(held))

    monkeypatch.setattr(substring_dedup, "_count", bounded)
    rng = random.Random(7)

    def some(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    passage = some(50)
    rows = [(i, " ".join(some(40) + passage + some(40))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, substring_dedup.substring_dedup(df).collect()), key=str)
    assert got == brute(rows) and all(r[2] == 50 for r in got)
