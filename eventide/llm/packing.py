"""Packing by power-of-two decomposition: a document is cut into pieces of binary lengths.

A document of n tokens becomes as many pieces of the longest length as fit, and one piece for
every binary digit of what is left. A piece is a sequence of its own, so that no sequence
crosses documents and none needs padding; sequences of one length form a bucket, from which
batches of equal shape are drawn.

Tokens: texts are cut into words where no token of the byte-level vocabulary can reach across.
Distinct words are encoded by the ``tokenizers`` library and put in place by index arrays.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.session import materialize

MOST = 1024  # tokens of a sequence; a power of two
END = 0  # the id after a document
CHUNK = 16 << 20  # bytes of texts encoded at once, unless one text has more
KNOWN = 400_000  # words kept from one chunk to the next

#: Kinds of bytes. Letters up to U+017F count, which are ASCII or lead by C3, C4 or C5; other bytes are left alone.
ASCII, SPACE, MARK, QUOTE, LETTER, LEAD = 1, 2, 4, 8, 16, 32


@cache
def _kinds() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[:128] = ASCII
    table[[9, 10, 11, 12, 13, 32]] |= SPACE
    table[33:127] |= MARK
    table[39] = ASCII | QUOTE
    for first, last in ((65, 90), (97, 122)):
        table[first:last + 1] = ASCII | LETTER
    table[[0xC3, 0xC4, 0xC5]] = LEAD
    return table


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _part int, _nth bigint"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their names in a text are ordinary text
    return found


class Words:
    """Ids of words, each encoded once while it is known."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known: dict[bytes, bytes] = {}

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words one after the other, and how many each word has."""
        if len(self.known) > KNOWN:
            self.known = {}
        names = words.to_pylist()
        new = [name for name in names if name not in self.known]
        for a in range(0, len(new), 1000):
            some = new[a:a + 1000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            self.known.update(zip(some, (array("I", e.ids).tobytes() for e in found), strict=True))
        raw = [self.known[name] for name in names]
        return np.frombuffer(b"".join(raw), np.uint32), np.fromiter(map(len, raw), np.int64, len(raw)) // 4


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    """One for all tasks of a worker, which run one after the other."""
    return Words(path)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def word_starts(data: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where texts laid end to end, beginning at ``firsts``, are cut into words.

    No token reaches across a cut, and no match of the vocabulary's pattern looks across it: after
    a letter, before any other ASCII character; after a visible mark that is no apostrophe, before
    a letter or white space; and after a lone line feed behind such a mark, before a letter.
    """
    kind = _kinds()[data]
    behind = np.zeros(len(data), np.uint8)  # what ends before each byte
    behind[1:] = kind[:-1]
    behind[2:][kind[:-2] == LEAD] = ASCII | LETTER
    for lead, rest in ((0xC3, 0x97), (0xC3, 0xB7)):  # the signs for times and divided by
        signs = np.flatnonzero((data[:-1] == lead) & (data[1:] == rest))
        kind[signs] = 0
        behind[np.minimum(signs + 2, len(data) - 1)] = 0
    letter = (kind & (LETTER | LEAD)) > 0
    mark = (behind & MARK) > 0
    cut = (behind == (ASCII | LETTER)) & ((kind & (ASCII | LETTER)) == ASCII)
    cut |= mark & (letter | ((kind & SPACE) > 0))
    cut[1:] |= (data[:-1] == 10) & mark[:-1] & letter[1:]
    cut[firsts] = True
    return np.flatnonzero(cut)


def encode_texts(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts (large strings without nulls) one after the other, and how many each text has."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    sizes = np.diff(ends)
    starts = word_starts(data, ends[:-1][sizes > 0]) if len(data) else np.empty(0, np.int64)
    cuts = np.append(starts, len(data))
    coded = pc.dictionary_encode(pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)]))
    ids, each = words.ids(coded.dictionary)
    which = coded.indices.to_numpy()
    taken = each[which]
    total = np.append(0, np.cumsum(taken))
    return ids[_spread((np.cumsum(each) - each)[which], taken)], np.diff(total[np.searchsorted(starts, ends)])


def binary_lengths(tokens: int, most: int = MOST) -> list[int]:
    """Full pieces first, then the binary digits of the rest, longest first."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of at most CHUNK bytes, or of one longer text."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + CHUNK, "right")))
            yield batch.column(0).slice(a, b - a), texts.slice(a, b - a)
            a = b


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST,
           end: int | None = END, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, and ``ids`` if asked for.

    ``_part`` and ``_nth`` are the task that cut a piece and its number among that task's pieces of its length.

    ``most`` is the longest length, a power of two. Ids are those of the vocabulary at ``path`` with
    ``end`` after them (None: nothing). A null text is empty: its document is the ``end`` alone, or
    without it has no piece. Rows that repeat an id, and null ids, are documents of their own. Texts
    of any length are whole: memory follows the longest text. Other columns are ignored. An empty
    table gives no rows.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most is not a power of two")
    where = path or vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, counted = _words(where), TaskContext.get().partitionId(), np.zeros(most.bit_length(), np.int64)
        for doc_ids, texts in _chunks(batches):
            ids, counts = encode_texts(texts, words)
            if end is not None:
                ids = np.insert(ids, np.cumsum(counts), end)
                counts = counts + 1
            lengths = [binary_lengths(n, most) for n in counts.tolist()]
            each = np.fromiter(map(len, lengths), np.int64, len(lengths))
            flat = np.fromiter((n for found in lengths for n in found), np.int64, int(each.sum()))
            row = np.repeat(np.arange(len(counts)), each)
            at = np.append(0, np.cumsum(flat))
            begin = (np.cumsum(counts) - counts)[row]
            raw = memoryview(ids.astype("<u4").view(np.uint8))
            sums = np.fromiter((zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)),
                               np.int64, len(flat))
            lane = np.log2(np.maximum(flat, 1)).astype(np.int64)
            nth = np.empty(len(flat), np.int64)
            for k in range(len(counted)):
                own = np.flatnonzero(lane == k)
                nth[own] = counted[k] + np.arange(len(own))
                counted[k] += len(own)
            columns = {"doc_id": doc_ids.take(pa.array(row)), "start": at[:-1] - begin, "length": flat,
                       "ids_crc32": sums, "doc_tokens": counts[row],
                       "_part": np.full(len(flat), part, np.int32), "_nth": nth}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, schema)


def with_sequences(found: DataFrame, name: str = "pieces") -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: one sequence each, numbered without gaps, longest bucket first.

    The pieces are written once. Every task has counted its pieces per bucket; sums of these
    counts, one row per task and length, say where a task's numbers begin.
    """
    placed = materialize(found, name)
    counts = placed.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # a row per length
    lanes = counts.groupBy("length").agg(F.sum("_rows").alias("_all")).select(
        "length", F.coalesce(F.sum("_all").over(longer), F.lit(0)).alias("_lane"))
    starts = counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).join(F.broadcast(lanes), "length")
    return (placed.join(starts.select("length", "_part", (F.col("_lane") + F.col("_before")).alias("_first")), ["length", "_part"])
            .withColumn("sequence_id", F.col("_first") + F.col("_nth")).withColumn("offset", F.lit(0).cast("long"))
            .select(*(c for c in found.columns if c not in ("_part", "_nth")), "sequence_id", "offset"))


def write_buckets(sequences: DataFrame, path: str, seed: int = 0) -> None:
    """Sequences as one folder per length, in an order drawn by ``seed`` inside each, for batches of equal shape."""
    (sequences.withColumn("_draw", F.xxhash64("sequence_id", F.lit(seed))).repartitionByRange("length", "_draw")
     .sortWithinPartitions("length", "_draw").drop("_draw").write.partitionBy("length").parquet(path))


def packed_documents(docs: DataFrame) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; see ``pieces``."""
    return with_sequences(pieces(docs, with_ids=False))
