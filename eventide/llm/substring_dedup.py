"""Repeated passages: windows of words that start in more than one place.

A window's minimiser is the shingle of smallest hash in it. Consecutive windows that
share a minimiser form a super-k-mer; it travels as one packed string to the bucket of
that minimiser, where sorting its windows counts them exactly. Equal windows have equal
minimisers, so buckets see every repetition.

First super-k-mers are compared by minimiser and a hash of their words. One whose
minimiser occurs once holds no repeated window; if all of a minimiser's are copies of
one, every window is repeated. Neither needs its words. Of the others one copy of each
travels. Buckets with very many different strings are never gathered: their windows
become 128-bit hashes, whose copies are summed with partial sums in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import byte_texts, hash_words, key_runs, mix, window_hashes
from eventide.session import materialize

WINDOW = 35  # words
SHINGLE = 5  # words of a minimiser
HOT = 2000  # different strings of a bucket from which on its windows are summed by hash
CHUNK = 1 << 20  # bytes of text at once
BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2^64


def minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every run of ``width``: from prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    pad = -len(values) % width
    blocks = np.append(values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def run_hashes(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of runs of word hashes: polynomials in ``BASE`` from differences of prefix sums."""
    n = len(words)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)
        down = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)
        sums = np.append(np.uint64(0), np.cumsum(words * up, dtype=np.uint64))
        return mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(np.uint64))


def super_kmers(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, number of windows, minimiser and hash of the words of each super-k-mer.

    A super-k-mer is a run of windows whose leftmost smallest shingle is at one place,
    so its own windows all differ.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    none = np.empty(0, np.int64)
    if not (sizes >= WINDOW).any():
        return none, none, none, none, none
    hashes = hash_words([w for ws in words for w in ws])
    shingles = window_hashes(hashes, SHINGLE)
    ranked = (shingles >> np.uint64(32) << np.uint64(32)) | np.arange(len(shingles), dtype=np.uint64)
    place = (minima(ranked, WINDOW - SHINGLE + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(words)), sizes)[:len(place)]
    whole = np.flatnonzero(np.arange(len(place)) + WINDOW <= ends[text_of])
    new = np.ones(len(whole), bool)
    new[1:] = (place[whole[1:]] != place[whole[:-1]]) | (np.diff(whole) != 1)
    first = np.flatnonzero(new)
    start = whole[first]
    text, n = text_of[start], np.diff(np.append(first, len(whole)))
    return (text, start - (ends - sizes)[text], n, shingles[place[start]].astype(np.int64),
            run_hashes(hashes, start, n + WINDOW - 1).astype(np.int64))


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, uid = byte_texts(batch.column("text")), batch.column("uid").to_numpy()
        for lo, hi in _chunks(texts):
            text, start, n, key, sid = super_kmers([t.split() for t in texts[lo:hi]])
            if len(text):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array(sid, pa.int64()), pa.array(uid[lo + text], pa.int64()),
                     pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["key", "sid", "uid", "start", "n"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked super-k-mers of each text: whole strings, or a hash of every window in hot buckets."""
    for batch in batches:
        texts, asked = byte_texts(batch.column("text")), batch.column("asked")
        for k, text in enumerate(texts):
            words = text.split()
            own = {c: asked[k].values.field(c).to_pylist() for c in ("key", "sid", "start", "n", "copies", "hot")}
            rows = []
            for key, sid, a, n, copies, hot in zip(*own.values(), strict=True):
                if hot:
                    rows += [(key, sid, None, 1, copies, o, xxhash.xxh3_128_digest(b" ".join(words[a + o:a + o + WINDOW])))
                             for o in range(n)]
                else:
                    rows.append((key, sid, b" ".join(words[a:a + n + WINDOW - 1]), n, copies, 0, None))
                if len(rows) >= 10_000:
                    yield _strings(rows)
                    rows = []
            if rows:
                yield _strings(rows)


def _strings(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
            pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
        names=["key", "sid", "packed", "n", "copies", "at", "window"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (key, sid, at, len) of windows that occur more than once in their bucket."""
    schema = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("at", pa.int32()), ("len", pa.int32())])
    for run in key_runs(batches, ["key"]):
        sids, packed, sizes, copies = (run.column(c).to_pylist() for c in ("sid", "packed", "n", "copies"))
        key = run.column("key")[0].as_py()
        if len(sids) == 1:  # the windows of one string all differ
            found = [(key, sids[0], 0, sizes[0])] if copies[0] > 1 else []
        else:
            windows = []
            for s, text in enumerate(packed):
                words = text.split(b" ")
                windows += [(b" ".join(words[o:o + WINDOW]), s, o) for o in range(sizes[s])]
            windows.sort()
            marks = [np.zeros(n, bool) for n in sizes]
            lo = 0
            for hi in range(1, len(windows) + 1):
                if hi == len(windows) or windows[hi][0] != windows[lo][0]:
                    if sum(copies[s] for _, s, _ in windows[lo:hi]) > 1:
                        for _, s, o in windows[lo:hi]:
                            marks[s][o] = True
                    lo = hi
            found = []
            for s, mark in enumerate(marks):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
                found += [(key, sids[s], int(a), int(b - a)) for a, b in zip(edges[::2], edges[1::2], strict=True)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*found, strict=True), schema, strict=True)],
                                             schema=schema)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = byte_texts(batch.column("text")), batch.column("spans")
        total, gone, digests = [], [], []
        for k, text in enumerate(texts):
            words = text.split()
            if spans[k].is_valid:
                depth = np.zeros(len(words) + 1, np.int64)
                starts, sizes = (spans[k].values.field(c).to_numpy() for c in ("start", "len"))
                np.add.at(depth, starts, 1)
                np.add.at(depth, starts + sizes + WINDOW - 1, -1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
            else:
                kept = words
            total.append(len(words))
            gone.append(len(words) - len(kept))
            digests.append(b" ".join(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.binary())],
            names=["doc_id", "n_words", "n_removed", "kept"])


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Runs of repeated windows (uid, start, len) of texts (uid, text)."""
    places = materialize(rows.mapInArrow(_places, "key long, sid long, uid long, start int, n int"), "super-kmers")
    twice = places.groupBy("key").count().where("count > 1").select("key")
    shared = materialize(places.join(twice, "key"), "shared-super-kmers")

    first = F.min(F.struct("uid", "start", "n"))
    strings = shared.groupBy("key", "sid").agg(F.count(F.lit(1)).alias("copies"), first.alias("f")).select(
        "key", "sid", "copies", "f.uid", "f.start", "f.n")
    strings = materialize(strings, "strings")
    buckets = strings.groupBy("key").agg(F.count(F.lit(1)).alias("strings"))
    asked = (strings.join(buckets.where("strings > 1").select("key", (F.col("strings") > HOT).alias("hot")), "key")
             .groupBy("uid").agg(F.collect_list(F.struct("key", "sid", "start", "n", "copies", "hot")).alias("asked")))
    packed = materialize(rows.join(asked, "uid").select("text", "asked").mapInArrow(
        _packed, "key long, sid long, packed binary, n int, copies long, at int, window binary"), "packed")
    cold = packed.where("window IS NULL").select("key", "sid", "packed", "n", "copies")
    counted = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_count, "key long, sid long, at int, len int")
    hot = packed.where("window IS NOT NULL").select("key", "window", "sid", "at", "copies")
    often = hot.groupBy("key", "window").agg(F.sum("copies").alias("all")).where("all > 1").select("key", "window")
    summed = hot.join(often, ["key", "window"]).select("key", "sid", "at", F.lit(1).alias("len"))
    alone = (strings.where("copies > 1").join(buckets.where("strings = 1"), "key")
             .select("key", "sid", F.lit(0).alias("at"), F.col("n").alias("len")))
    marks = materialize(counted.union(summed).union(alone), "repeated-windows")
    return shared.select("key", "sid", "uid", "start").join(marks, ["key", "sid"]).select(
        "uid", (F.col("start") + F.col("at")).alias("start"), "len")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, per document.

    Each word that a window of ``WINDOW`` words covers goes if the window's words also
    start anywhere else, in the same text or another; windows are judged on the input.
    Words are runs of non-space bytes, unchanged. Null texts have no words; texts shorter
    than a window keep all. A row is known by its id and text, so rows that repeat an id,
    and rows without one, stay rows of their own, and equal rows lose what they share.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("uid"))
    spans = repeated_spans(rows.select("uid", "text")).distinct().groupBy("uid").agg(
        F.collect_list(F.struct("start", "len")).alias("spans"))
    return rows.join(spans, "uid", "left").select("doc_id", "text", "spans").mapInArrow(
        _removed, "doc_id long, n_words long, n_removed long, kept binary")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
