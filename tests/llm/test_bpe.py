import base64
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from eventide.llm import bpe, queries


@pytest.fixture(scope="module")
def tokeniser():
    lines = open(public_tokenizers.path(bpe.VOCABULARY), "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(tokeniser, rows):
    out = []
    for d, t in rows:
        ids = tokeniser.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_pieces_against_the_pattern():
    pattern, rng = regex.compile(public_tokenizers.PATTERN), random.Random(0)
    signs = "ab's tremvldS'  \n\t  　é1٣²!?-,'’🙂́ \x85\x1c"
    for _ in range(3000):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(4)]
        pieces, counts = bpe._pieces(texts)
        assert pieces == [p for t in texts for p in pattern.findall(t)]
        assert counts == [len(pattern.findall(t)) for t in texts]


def test_blocks_hold_all_documents(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 20)
    monkeypatch.setattr(bpe, "CHUNK", 10)
    texts = ["some words here", None, "x " * 50, "", "last one"] * 3
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(15)), "text": texts})
    blocks = [b.to_pylist()[0] for b in bpe._blocks(iter([batch, batch]))]
    assert len(blocks) > 2
    assert [i for b in blocks for i in b["doc_ids"]] == list(range(15)) * 2
    words = [b["words"][p] for b in blocks for p in np.frombuffer(b["places"], np.int32)]
    assert "".join(words) == "".join(t or "" for t in texts) * 2


def test_against_the_library(spark, tokeniser):
    rng = random.Random(1)
    signs = "abcdefgh  '\n.,éß漢字🙂0123"
    rows = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "<|endoftext|> don't I'LL we'll"), (102, "ab " * 40_000), (5, "twice"), (5, "twice"),
             (103, "﻿x​   "), (104, "x" * 150)]
    df = spark.createDataFrame([(*r, 0, "w") for r in rows], "doc_id long, text string, ids int, words string").repartition(3)
    assert sorted(map(tuple, bpe.tokenised(df).collect()), key=str) == digests(tokeniser, rows)
    want = sorted((str(d), tokeniser.encode_ordinary(t or "")) for d, t in rows)
    for encode in (bpe.encode, bpe.encode_by_functions):
        assert sorted((str(r.doc_id), list(r.ids)) for r in encode(df, bpe.ranks()).collect()) == want


def test_long_pieces(tokeniser):
    rng = random.Random(2)
    rank = {t.encode("latin-1"): r for t, r in bpe.ranks().items()}
    single = [bytes([b]) for b in range(256)]
    for n in (1, 2, 5, 40, 300, 399, 400, 900, 5000):
        for signs in ("ab", "etaoinshr", "é漢aß"):
            word = "".join(rng.choice(signs) for _ in range(n))
            assert bpe.merge(word.encode(), rank, single) == bpe._merge_long(word.encode(), rank) == tokeniser.encode_ordinary(word)


def test_empty_table(spark):
    assert bpe.tokenised(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_driver_table(spark, sf_dir, tokeniser):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    assert sorted(map(tuple, queries.op5_byte_bpe(spark, sf_dir).collect()), key=str) == digests(tokeniser, rows)
