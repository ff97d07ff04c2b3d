"""Packing against the tokenizers library and the definition of pieces."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventide.llm import packing

SCHEMA = "doc_id long, text string"


def library_ids(text: str) -> list[int]:
    return packing._tokenizer(packing.vocabulary_path()).encode(text, add_special_tokens=False).ids


def plain(rows, most=1024):
    out = []
    for doc_id, text in rows:
        ids = [*library_ids(text or ""), 0]
        at = 0
        for n in packing.binary_lengths(len(ids), most):
            part = ids[at:at + n]
            out.append((doc_id, at, n, zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
            at += n
        assert at == len(ids)
    return sorted(out, key=repr)


def texts() -> list[tuple]:
    rng = random.Random(3)
    words = ["the", "Wald", "don't", "he'll", "12,345", "x=1", "naïve", "日本語", "e\u0301", "A-B", "...", "\u00a0", "\n", "\t", "", ""]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 900)))) for i in range(40)]
    return rows + [(50, None), (51, ""), (52, " "), (53, "  two  spaces  "), (54, "<|endoftext|> is a word"), (55, "a" * 5000),
                   (56, "word " * 30_000), (None, "no id"), (1, "again"), (57, "line \n  next\n\n end "), (58, "\u2003em \u3000wide")]


@pytest.mark.parametrize("most", [1024, 8])
def test_pieces_equal_the_library(spark, most):
    rows = texts()
    found = packing.pieces(spark.createDataFrame(rows, SCHEMA), most=most).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found), key=repr) == plain(rows, most)
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in found)


def test_sequences_are_whole_and_numbered(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = packing.packed_documents(docs).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found), key=repr) == plain(rows)
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024 for r in found)
    lengths = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab1's \n\t\u00a0\u3000.é,_|日²\u0301\x1c\x85\u200b"), max_size=40), min_size=1, max_size=5))
def test_cut_words_have_the_ids_of_the_text(found):
    ids, counts = packing.encode_texts(pa.array(found, pa.large_string()), packing.Words(packing.vocabulary_path()))
    want = [library_ids(t) for t in found]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_lengths_are_binary():
    assert packing.binary_lengths(2 * 1024 + 7) == [1024, 1024, 4, 2, 1]
    assert packing.binary_lengths(0) == []
    assert packing.binary_lengths(8, 4) == [4, 4]


def test_buckets_and_edges(spark, tmp_path):
    docs = spark.createDataFrame([(i, "some words here " * i, 1, 2) for i in range(30)], SCHEMA + ", length int, _part int")
    packing.write_buckets(packing.with_sequences(packing.pieces(docs)), str(tmp_path / "buckets"), seed=7)
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert back.where("size(ids) <> length").isEmpty()
    assert back.selectExpr("sum(length)").first()[0] == sum(len(library_ids("some words here " * i)) + 1 for i in range(30))
    assert packing.packed_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    assert packing.pieces(spark.createDataFrame([(1, None)], SCHEMA), end=None).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(docs, most=1000)
