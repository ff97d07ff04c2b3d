import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from eventide.llm import queries
from eventide.llm.near_dedup import HASHES, STEP, bayes_survivors, least_matches, near_components, shingle_sets, signatures


def brute(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            held[g].append(i)
    for i, s in enumerate(sets):
        if rows[i][0] is None:
            continue
        shared = defaultdict(int)
        for g in s:
            for j in held[g]:
                if j < i and rows[j][0] is not None:
                    shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = None if d is None else min(x for x in least[find(i)] if x is not None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def made(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = [(1000, None), (1001, ""), (1002, " \t"), (1003, "One two"), (1004, "one TWO"), (None, "one two"),
            (1005, "x" * 300_000), (1006, "É a b c d e"), (1007, "é a b c d e")]
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 150, 600]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.randrange(10**6), " ".join(copy)))
    chain = [rng.choice(words) for _ in range(200)]
    for i in range(30):  # neighbours are linked, ends are not
        chain = list(chain)
        chain[rng.randrange(200)] = f"n{i}"
        rows.append((5 * 10**6 - i, " ".join(chain)))
    return rows + [rows[12], rows[12]]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, node long, sig string").repartition(3)
    assert sorted(map(tuple, near_components(df).collect()), key=str) == brute(rows)


def test_same_id_with_two_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (0, "a b c d e f g"), (2, "p q r s t u v")]
    got = near_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(0, 0), (1, 0), (1, 1), (2, 1)]


def test_empty_table(spark):
    assert near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bayes_keeps_similar_and_drops_distant():
    base = [f"w{i}".encode() for i in range(1000)]
    near = base[:970] + [b"x%d" % i for i in range(30)]
    far = base[:600] + [b"y%d" % i for i in range(400)]
    sigs = signatures(shingle_sets([b" ".join(x) for x in (base, near, far)]))
    assert sigs.shape == (3, HASHES)
    assert bayes_survivors(sigs[:1], sigs[1:], least_matches()).tolist() == [0]
    assert least_matches() == sorted(least_matches()) and len(least_matches()) == HASHES // STEP


def test_query_on_driver_table(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = sorted(map(tuple, queries.op9_near_dedup(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
    assert any(not r[3] for r in got)


def test_least_matches_follows_the_posterior():
    grid = (np.arange(200_000) + 0.5) / 200_000
    for n, need in zip(range(STEP, HASHES + 1, STEP), least_matches(), strict=True):
        for m in (need - 1, need):
            if m >= 0:
                mass = grid**m * (1 - grid) ** (n - m)
                above = mass[grid > 0.85].sum() / mass.sum()
                assert (above < 1e-6) == (m < need)
