"""Prefix trie against a plain version that lists every prefix."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

from eventide.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, tie, role, text))
    paths = {}
    for conv, found in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        base = abs(conv) // 5 * 5 * (1 if conv >= 0 else -1)
        paths[conv] = [t[3:] for t in sorted(own.get(base, []))[:h] + sorted(found)[h:]]
    members = defaultdict(list)
    for conv, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = {}
    for node in sorted(members, key=len, reverse=True):
        convs, below = members[node], [out[c] for c in children[node]]
        saved = (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
        ends = ",".join(str(c) for c in convs if len(paths[c]) == len(node))
        out[node] = (convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(below),
                     sum(b[5] for b in below) or 1, saved + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def check(spark, rows, schema=SCHEMA):
    found = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, schema))
    assert found.columns == COLUMNS
    assert sorted(map(tuple, found.collect()), key=repr) == plain([r[:4] for r in rows])


def conversations(seed=1, n=120):
    rng = random.Random(seed)
    rows = []
    for conv in range(-6, n):
        if conv % 7 == 3:
            continue
        for turn in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((conv, turn, rng.choice(["user", "bot"]) if turn % 5 == 4 else "user", rng.choice(["hello", "ä b", "", "so " * 9][:1 + turn % 4])))
    return rows


def test_equals_the_plain_trie(spark):
    check(spark, conversations())


def test_nulls_ties_and_long(spark):
    rows = conversations(2, 20)
    rows += [(40, None, None, None), (40, None, "user", "first"), (40, 1, None, ""), (40, 1, "", None), (None, 1, "user", "of no conversation"),
             (41, 3, "user", "x" * 300_000), (41, 3, "user", "x" * 300_000), (45, 0, "user", "lone")]
    rows += [(50, t, "user", f"turn {t % 3}") for t in range(70)] + [(51, t, "user", f"turn {t % 3}") for t in range(75)]
    check(spark, [(*r, 1, b"x", 2) for r in rows], SCHEMA + ", depth int, node binary, pos int")


def test_blocks_and_crowded_nodes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "SHARE", 5)
    rows = conversations(3, 60) + [(c, 0, "user", "the same") for c in range(100, 160)]
    check(spark, rows + [(200, t, "user", f"{t}") for t in range(40)])


def test_only_turnless_and_empty(spark):
    turnless = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    check(spark, [(turnless, 0, "user", "replaced")])
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_without_rebuilding(spark):
    rows = [(c, t, "user", f"{t}") for c in range(3) for t in range(c + 1)]
    found = prefix_trie.prefix_trie(*prefix_trie.plain(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert sorted((r.depth, r.n_convs) for r in found) == [(0, 3), (1, 3), (2, 2), (3, 1)]
    assert len({r.node for r in found}) == 4
