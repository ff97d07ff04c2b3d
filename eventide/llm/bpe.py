"""Byte-level BPE: ranked merges folded over the bytes of distinct words; decoding concatenates pieces.

Tasks cut texts into the pattern's pieces and keep the distinct ones; a fold merges the
bytes of each distinct piece by a rank map, and the ids are laid out per document.
Nothing is shuffled. The fold exists twice with equal results: ``encode`` folds in the
task that cut the texts, ``encode_by_functions`` hands blocks of distinct pieces to
Spark's higher-order functions with the ranks as a literal map. The second costs more
than the time budget allows (see the README), so the query uses the first.

Decoding looks up each id's bytes in a literal array and concatenates them. Bytes are
held as Latin-1 strings there, one character a byte, as the functions on arrays and
maps of strings are complete.
"""

from __future__ import annotations

import base64
import heapq
import json
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
BUCKETS = 8192  # small maps the ranks are dealt to, as a map is searched from its start
BLOCK = 4_000_000  # pieces of a block of documents at most, unless one text has more
CHUNK = 1 << 19  # characters cut at once
MOST_WORDS = 400_000  # distinct pieces a task remembers before it starts afresh
LONG = 400  # bytes from which on a piece is merged with a heap

#: Code points with the property White_Space; fixed values.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def piece_starts(points: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pieces of the public pattern begin, in texts laid end to end.

    Runs of letters, numbers and others are pieces. Of white space before a run the
    last character is a piece of its own, or joins the run if it is a blank; white
    space at the end of a text is one piece. A lone apostrophe that no blank joins
    takes the ending s, t, re, ve, m, ll or d with it.
    """
    n = len(points)
    kind = _classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[text_starts] = True
    opens[n] = True
    edge = opens.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(edge[:n])
    ends = np.append(starts[1:], n)
    cut = edge[:n].copy()
    spaces = (kind[starts] == SPACE) & ~opens[ends]  # white space with something behind it
    last = ends[spaces] - 1
    cut[last] = True
    joined = last[points[last] == 32] + 1
    cut[joined] = False
    lone = starts[(points[starts] == 39) & (ends - starts == 1) & cut[starts]]
    lone = lone[~opens[lone + 1]]
    lone = lone[kind[np.minimum(lone + 1, n - 1)] == LETTER]
    if len(lone):
        one = points[lone + 1]
        two = np.where((lone + 2 < n) & ~edge[np.minimum(lone + 2, n)], points[np.minimum(lone + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e")))
                         | ((one == ord("l")) & (two == ord("l"))))
        for hit, size in ((lone[short], 2), (lone[long], 3)):
            cut[hit + 1] = False
            after = hit + size
            cut[after[after < n]] = True
    return np.flatnonzero(cut)


def _pieces(texts: list[str]) -> tuple[list[str], list[int]]:
    """The pieces of the texts one after the other, and their number in each text."""
    joined = "".join(texts)
    if not joined:
        return [], [0] * len(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) for t in texts])
    firsts = np.cumsum(sizes) - sizes
    starts = piece_starts(points, firsts[sizes > 0])
    at = starts.tolist()
    pieces = [joined[a:b] for a, b in zip(at, [*at[1:], len(joined)], strict=True)]
    return pieces, np.diff(np.searchsorted(starts, np.append(firsts, len(joined)))).tolist()


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block: ids of documents, pieces in each, each piece's place among the distinct ones."""
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("places", pa.binary()),
                        ("words", pa.list_(pa.string()))])

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(
            (ids, sizes, b"".join(places), list(words)), schema, strict=True)], schema=schema)

    ids, sizes, places, words, held = [], [], [], {}, 0
    for batch in batches:
        texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
        names = batch.column("doc_id").to_pylist()
        for lo, hi in _chunks(texts):
            pieces, counts = _pieces(texts[lo:hi])
            if held and held + len(pieces) > BLOCK:
                yield packed()
                ids, sizes, places, words, held = [], [], [], {}, 0
            places.append(np.array([words.setdefault(p, len(words)) for p in pieces], np.int32).tobytes())
            ids += names[lo:hi]
            sizes += counts
            held += len(pieces)
    if ids:
        yield packed()


def ranks(path: str | None = None) -> dict[str, int]:
    """Tokens (as Latin-1 strings) and their ranks, from a rank file read by the driver."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def rank_lookup(vocabulary: dict[str, int]) -> Callable[[Column], Column]:
    """Rank of a token, or null, by a literal array of small maps."""
    dealt: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in vocabulary.items():
        dealt[zlib.crc32(token.encode()) % BUCKETS][token] = rank
    maps = F.from_json(F.lit(json.dumps({"m": dealt})), "m array<map<string,int>>")["m"]
    return lambda token: F.try_element_at(
        F.element_at(maps, (F.crc32(token.cast("binary")) % BUCKETS + 1).cast("int")), token)


def merge_fold(word: Column, rank: Callable[[Column], Column]) -> Column:
    """Ids of one piece given as a Latin-1 string: the leftmost pair of lowest rank merges, until none does.

    The state holds the parts and the ranks of neighbouring pairs; a merge asks for
    the two new pairs only.
    """
    def start(parts: Column) -> Column:
        pairs = F.transform(F.slice(parts, 2, F.size(parts)), lambda right, i: rank(F.concat(F.element_at(parts, i + 1), right)))
        return F.struct(parts.alias("parts"), pairs.alias("pairs"))

    def merged(state: Column, at: Column) -> Column:
        parts, pairs, n = state["parts"], state["pairs"], F.size(state["parts"])

        def built(token: Column) -> Column:
            none = F.array().cast("array<int>")
            left = F.when(at > 1, F.array(rank(F.concat(F.element_at(parts, F.greatest(at - 1, F.lit(1))), token)))).otherwise(none)
            right = F.when(at + 2 <= n, F.array(rank(F.concat(token, F.element_at(parts, F.least(at + 2, n)))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(parts, 1, at - 1), F.array(token), F.slice(parts, at + 2, n)).alias("parts"),
                F.concat(F.slice(pairs, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(pairs, at + 2, n)).alias("pairs"))
        return _let(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)), built)

    def step(state: Column, _: Column) -> Column:
        return F.when(F.array_min(state["pairs"]).isNull(), state).otherwise(
            _let(F.array_position(state["pairs"], F.array_min(state["pairs"])).cast("int"), lambda at: merged(state, at)))

    def folded(parts: Column) -> Column:
        return F.aggregate(F.slice(parts, 2, F.size(parts)), start(parts), step, lambda s: F.transform(s["parts"], rank))

    return _let(rank(word), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(
        _let(F.split(word, ""), folded)))


def merge(word: bytes, rank: dict[bytes, int], single: list[bytes]) -> list[int]:
    """Ids of one piece: the leftmost pair of lowest rank merges, until none does."""
    whole = rank.get(word)
    if whole is not None:
        return [whole]
    if len(word) >= LONG:
        return _merge_long(word, rank)
    never, get = 1 << 60, rank.get
    parts = [single[b] for b in word]
    pairs = [get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        best = min(pairs)
        if best == never:
            break
        i = pairs.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], never)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], never)
    return [rank[p] for p in parts]


def _merge_long(word: bytes, rank: dict[bytes, int]) -> list[int]:
    """The same for long pieces: a heap of pairs over linked parts [begin, end)."""
    end = list(range(1, len(word) + 1))
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if 0 <= i and end[i] < len(word):
            r = rank.get(word[i:end[end[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

    for i in range(len(word)):
        offer(i)
    gone = bytearray(len(word))
    while heap:
        _, i, stop = heapq.heappop(heap)
        if gone[i] or end[i] == len(word) or end[end[i]] != stop:
            continue  # one of the two parts has merged since
        gone[end[i]] = 1
        end[i] = stop
        if stop < len(word):
            before[stop] = i
        offer(i)
        offer(before[i])
    out, i = [], 0
    while i < len(word):
        out.append(rank[word[i:end[i]]])
        i = end[i]
    return out


def _laid_out(places: np.ndarray, flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    """Lists of ids of documents with ``counts`` pieces each; piece p has ids flat[begins[p]:begins[p + 1]]."""
    lengths = begins[places + 1] - begins[places]
    total = np.cumsum(lengths)
    shift = np.repeat(begins[places] - (total - lengths), lengths)
    values = flat[np.arange(len(shift)) + shift] if len(shift) else np.empty(0, np.int32)
    edges = np.append(0, total)[np.append(0, np.cumsum(counts))]
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, vocabulary: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and token ids of each text; no special tokens.

    A null or empty text has no ids. Rows that repeat an id stay rows of their own;
    other columns are ignored; an empty table gives no rows.
    """
    rank = {token.encode("latin-1"): r for token, r in vocabulary.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = [bytes([b]) for b in range(256)]
        words: dict[str, int] = {}
        flat, begins = array("i"), array("q", [0])
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            for lo, hi in _chunks(texts):
                if len(words) > MOST_WORDS:
                    words, flat, begins = {}, array("i"), array("q", [0])
                pieces, counts = _pieces(texts[lo:hi])
                known = len(words)
                places = np.array([words.setdefault(p, len(words)) for p in pieces], np.int64)
                for word in islice(words, known, None):
                    flat.extend(merge(word.encode(), rank, single))
                    begins.append(len(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo),
                     _laid_out(places, np.array(flat, np.int32), np.array(begins, np.int64), np.array(counts))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def encode_by_functions(docs: DataFrame, vocabulary: dict[str, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same as ``encode``, folded by higher-order functions."""
    rank = rank_lookup(vocabulary)
    blocks = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _blocks, "doc_ids array<long>, sizes array<int>, places binary, words array<string>")
    coded = blocks.select("doc_ids", "sizes", "places", F.transform(
        "words", lambda w: merge_fold(F.decode(F.encode(w, "UTF-8"), "ISO-8859-1"), rank)).alias("ids"))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                names, sizes, ids = (batch.column(c)[k].values for c in ("doc_ids", "sizes", "ids"))
                places = np.frombuffer(batch.column("places")[k].as_py(), np.int32)
                flat, begins = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
                stops = np.cumsum(sizes.to_numpy())
                lo = 0
                while lo < len(names):  # a bounded run of documents at a time
                    first = stops[lo - 1] if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(stops, first + CHUNK, "right")))
                    yield pa.RecordBatch.from_arrays(
                        [names.slice(lo, hi - lo), _laid_out(places[first:stops[hi - 1]], flat, begins, sizes.to_numpy()[lo:hi])],
                        names=["doc_id", "ids"])
                    lo = hi

    return coded.mapInArrow(lay_out, "doc_id long, ids array<int>")


def decode(ids: Column, vocabulary: dict[str, int]) -> Column:
    """The bytes of a list of ids."""
    tokens = [""] * (max(vocabulary.values(), default=-1) + 1)
    for token, rank in vocabulary.items():
        tokens[rank] = token
    literal = F.from_json(F.lit(json.dumps({"t": tokens})), "t array<string>")["t"]
    return F.encode(F.array_join(F.transform(ids, lambda i: F.element_at(literal, i + 1)), ""), "ISO-8859-1")


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's columns: number of ids, digest of the ids, digest of the decoded bytes."""
    vocabulary = ranks(path)
    return encode(docs, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), vocabulary), 256).alias("decoded_sha256"))
