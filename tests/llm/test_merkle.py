"""Merkle manifest against a plain recursive version."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from eventide.llm.merkle import merkle_manifest, proofs, verified_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: object) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row: tuple, text: str | None) -> str:
    doc_id, _, lang, source, n_chars = row
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def tree(digests: list[str], fanout: int) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Root, and per leaf its steps (before, after)."""
    steps: list[list] = [[] for _ in digests]
    below = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        runs = [range(a, min(a + fanout, len(digests))) for a in range(0, len(digests), fanout)]
        for run in runs:
            for i in run:
                for j in below[i]:
                    steps[j].append(([digests[k] for k in run if k < i], [digests[k] for k in run if k > i]))
        below = [[j for i in run for j in below[i]] for run in runs]
        digests = [sha("".join(digests[i] for i in run)) for run in runs]
    return digests[0], steps


def plain(rows: list[tuple], fanout: int = 3) -> list[tuple]:
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        parts.append((own, *tree([leaf(r, r[1]) for r in own], fanout)))
    root, over = tree([p[1] for p in parts], fanout)
    out = []
    for (own, subroot, steps), up in zip(parts, over, strict=True):
        for r, way in zip(own, steps, strict=True):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            acc = leaf(r, text)
            for before, after in way + up:
                acc = sha("".join([*before, acc, *after]))
            proof = sha("".join("".join(b + a) for b, a in way + up))
            out.append((r[0], leaf(r, r[1]), subroot, root, proof, acc, acc == root))
    return out


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted(map(tuple, rows), key=repr)


def documents() -> list[tuple]:
    rows = [(i, f"text {i}\nline" if i % 3 else f"text {i}", "en", f"s{i % 4}" if i % 2 else "hot", i) for i in range(60)]
    rows += [(100, "alone", "en", "single", 5), (101, None, None, None, None), (None, "no id\n", "de", "s1", 3),
             (102, "", "", "", 0), (5, "the id again", "en", "s1", 1), (7, "text 7\nline", "en", "s3", 7),
             (103, "ä\n" * 20_000, "de", "Ä", 40_000), (-4, "below zero\n", "en", "hot", None)]
    return rows


@pytest.mark.parametrize("fanout", [2, 3, 5])
def test_equals_the_plain_tree(spark, fanout):
    rows = documents()
    out = verified_documents(spark.createDataFrame(rows, SCHEMA), fanout)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(out.collect()) == ordered(plain(rows, fanout))


@pytest.mark.parametrize("n", [1, 3, 4, 10])
def test_sizes_of_one_source(spark, n):
    rows = [(i, f"{i}\n", "en", "only", i) for i in range(n)]
    assert ordered(verified_documents(spark.createDataFrame(rows, SCHEMA)).collect()) == ordered(plain(rows))


def test_equal_rows_stay_rows(spark):
    rows = [(1, "same", "en", "a", 4)] * 30 + [(2, "other", "en", "a", 5)]
    assert ordered(verified_documents(spark.createDataFrame(rows, SCHEMA)).collect()) == ordered(plain(rows))


def test_empty_table_and_clashing_columns(spark):
    assert verified_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(i, f"t{i}", "en", "a", 1, "x", 2, 3) for i in range(5)],
                                 SCHEMA + ", key string, pos int, _salt int")
    assert ordered(verified_documents(docs).collect()) == ordered(plain([(i, f"t{i}", "en", "a", 1) for i in range(5)]))


def test_one_changed_text_is_found_where_it_is(spark):
    rows = documents()
    first = merkle_manifest(spark.createDataFrame(rows, SCHEMA))
    rows[10] = (10, "changed", *rows[10][2:])
    second = merkle_manifest(spark.createDataFrame(rows, SCHEMA))
    assert first.root != second.root
    before, after = (set(map(tuple, m.names.select("name", "digest").collect())) for m in (first, second))
    assert {name for name, _ in before ^ after} == {"=hot"}
    assert proofs(second).count() == len(rows)
