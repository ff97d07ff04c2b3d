"""Katz backoff language model: Good-Turing discounts and exactly normalised backoff weights.

The corpus is kept as blocks of documents, each with its distinct words and its tokens
as places among them. For every order a block sends its distinct n-grams with their
training counts to buckets by hash; a bucket adds them up, is the stored part of that
order's table, and answers each block with the totals. A second exchange per order
adds up what each history's seen continuations take, which fixes its backoff weight.
With all answers at hand a block evaluates the recursion for its distinct n-grams and
sums over the tokens of each document.

Sums never hold a row per token outside a block, a frequent n-gram is one entry per
block, and every table is written, so lost executors cost one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import byte_texts, hash_words, held_out, key_runs, mix
from eventide.session import materialize

ORDER = 2
CUT = 5  # counts above it are not discounted
BLOCK = 800_000  # tokens of a block, unless one text has more
CHUNK = 1 << 20  # bytes of text at once
START = np.uint64(0x5BF0363DB3C4A6D1)  # stands before a text
END = np.uint64(0x1B873593CC9E2D51)  # the token after it
STEP = np.uint64(0x9E3779B97F4A7C15)


def _shrink(x: np.ndarray) -> bytes:
    """Compressed bytes, equal bytes of all values side by side."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T) if len(x) else x.view(np.uint8)
    return np.int64(len(x)).tobytes() + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def _grow(data: bytes, kind: type) -> np.ndarray:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    if not n:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, which are held out, tokens in each (its end included), places, distinct words' hashes."""
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                        ("sizes", pa.list_(pa.int32())), ("places", pa.binary()), ("words", pa.binary())])
    part, made = TaskContext.get().partitionId(), 0
    ids, held, sizes, places, words, total = [], [], [], [], {b"\n": 0}, 0

    def packed() -> pa.RecordBatch:
        hashes = hash_words(list(words))
        hashes[0] = END
        row = (part * 1_000_000 + made, ids, held, sizes, _shrink(np.concatenate(places)), _shrink(hashes))
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(row, schema, strict=True)], schema=schema)

    for batch in batches:
        texts = byte_texts(batch.column("text"))
        names, out = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
        for k, text in enumerate(texts):
            own = text.lower().split()
            if total and total + len(own) + 1 > BLOCK:
                yield packed()
                made += 1
                ids, held, sizes, places, words, total = [], [], [], [], {b"\n": 0}, 0
            places.append(np.array([words.setdefault(w, len(words)) for w in own] + [0], np.int32))
            ids.append(names[k])
            held.append(out[k])
            sizes.append(len(own) + 1)
            total += len(own) + 1
    if ids:
        yield packed()


@dataclass
class Grams:
    """The distinct n-grams of one order in a block, sorted by hash."""

    keys: np.ndarray
    of_token: np.ndarray  # which of them ends at each token
    first: np.ndarray  # a token at which each ends
    history: np.ndarray  # hash of each one's history


class Block:
    def __init__(self, row: dict):
        self.doc_ids, self.held = row["doc_ids"], np.array(row["held"], bool)
        self.sizes = np.array(row["sizes"], np.int64)
        self.tokens = _grow(row["words"], np.uint64)[_grow(row["places"], np.int32)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.at = np.arange(len(self.tokens)) - np.repeat(self.starts, self.sizes)
        self.learned = np.repeat(~self.held, self.sizes)

    def grams(self, order: int) -> Grams:
        state = np.zeros(len(self.tokens), np.uint64)
        with np.errstate(over="ignore"):
            for back in range(order - 1, 0, -1):
                word = np.where(self.at >= back, np.roll(self.tokens, back), START)
                state = mix(state + word + STEP)
            whole = mix(state + self.tokens + STEP)
        keys, first, of_token = np.unique(whole, return_index=True, return_inverse=True)
        return Grams(keys, of_token, first, state[first])


def exchange(blocks: DataFrame, buckets: int, send: Callable[[dict], tuple[np.ndarray, list[np.ndarray]]],
             combine: Callable[[np.ndarray, int, list[np.ndarray]], tuple[list[np.ndarray], np.ndarray]],
             kinds: tuple[type, ...], name: str) -> DataFrame:
    """Blocks send sorted keys with values; buckets of a hash range combine equal keys and answer.

    ``combine`` gets each entry's key number, the number of keys and the values, and
    returns answers per entry and a few sums of the bucket. The written result has an
    answer row (block, bucket, answer) per block and bucket, and a row with a null block
    and the ``sums`` per bucket.
    """
    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _answered_blocks(batches):
            keys, values = send(row)
            bucket = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            edges = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(keys)), strict=True):
                own = keys[a:b].copy()
                own[1:] = np.diff(keys[a:b])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[a])], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([_shrink(own)], pa.binary()),
                     pa.array([[_shrink(v[a:b].copy()) for v in values]], pa.list_(pa.binary()))],
                    names=["bucket", "block", "keys", "data"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("answer", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])
        for run in key_runs(batches, ["bucket"]):
            parts = [np.cumsum(_grow(x, np.uint64), dtype=np.uint64) for x in run.column("keys").to_pylist()]
            values = [np.concatenate([_grow(x[v], kind) for x in run.column("data").to_pylist()]) for v, kind in enumerate(kinds)]
            unique, number = np.unique(np.concatenate(parts), return_inverse=True)
            answers, sums = combine(number, len(unique), values)
            bucket, blocks_of = run.column("bucket")[0].as_py(), run.column("block").to_pylist()
            edges = np.append(0, np.cumsum([len(p) for p in parts]))
            for i, block in enumerate(blocks_of):
                cut = slice(edges[i], edges[i + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t.type) for x, t in zip(
                        ([block], [bucket], [[_shrink(a[cut].copy()) for a in answers]], [None]), schema, strict=True)], schema=schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(
                ([None], [bucket], [None], [sums.tolist()]), schema, strict=True)], schema=schema)

    rows = (blocks.mapInArrow(sent, "bucket long, block long, keys binary, data array<binary>")
            .repartition("bucket").sortWithinPartitions("bucket", "block"))
    return materialize(rows.mapInArrow(answered, "block long, bucket long, answer array<binary>, sums array<long>"), name)


def _count(number: np.ndarray, n: int, values: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Totals, doubled, plus one for the entry that stands for a learned n-gram; counts of counts, tokens, types."""
    total = np.bincount(number, values[0], n).astype(np.int64)
    some = np.flatnonzero(values[0])
    own = np.zeros(len(number), np.int64)
    own[some[np.unique(number[some], return_index=True)[1]]] = 1
    of_counts = np.bincount(np.minimum(total, CUT + 2), minlength=CUT + 3)[1:CUT + 2]
    return [total[number] * 2 + own], np.append(of_counts, [total.sum(), (total > 0).sum()])


def _weigh(number: np.ndarray, n: int, values: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per history what its counts are divided by, and its backoff weight."""
    count, kept, lower = (np.bincount(number, v, n) for v in values)
    whole = np.where(count - kept > 1e-9 * np.maximum(count, 1), count, count + 1)  # nothing was discounted: one more event
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(count > 0, (1 - kept / whole) / np.maximum(1 - lower, 1e-12), 1.0)
    return [whole[number], weight[number]], np.zeros(0, np.int64)


def discounts(of_counts: list[int]) -> np.ndarray:
    """Katz's factors for counts 0 to ``CUT`` + 1, from the numbers of n-grams seen 1 to ``CUT`` + 1 times.

    Where the counts of counts give no factor between 0 and 1, absolute discounting
    with n1 / (n1 + 2 n2) stands in.
    """
    n = np.array([0, *of_counts], float)
    steady = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    factor = np.ones(CUT + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = (CUT + 1) * n[CUT + 1] / n[1]
        for r in range(1, CUT + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
            factor[r] = d if 0 < d < 1 else (r - min(steady, 0.999)) / r
    return factor


@dataclass(frozen=True)
class Order:
    """What the driver knows of one order: a few numbers."""

    factor: np.ndarray
    tokens: int
    types: int
    of_counts: tuple[int, ...]

    def kept(self, count: np.ndarray) -> np.ndarray:
        return count * self.factor[np.minimum(count, CUT + 1)]

    @property
    def unigrams(self) -> tuple[float, float]:
        """What unigram counts are divided by, and the probability left for words never seen."""
        lost = float((np.array(self.of_counts[:CUT]) * np.arange(1, CUT + 1) * (1 - self.factor[1:CUT + 1])).sum())
        whole = self.tokens if lost else self.tokens + 1  # nothing was discounted: one more event
        return whole, (lost or 1) / whole


def summary(table: DataFrame) -> Order:
    rows = table.where("block IS NULL").select("sums").collect()  # one short row per bucket
    sums = np.sum([r.sums for r in rows], axis=0, dtype=np.int64) if rows else np.zeros(CUT + 3, np.int64)
    return Order(discounts(sums[:CUT + 1].tolist()), int(sums[-2]), int(sums[-1]), tuple(sums[:CUT + 1].tolist()))


def _answer(row: dict, name: str, value: int, kind: type) -> np.ndarray:
    parts = row.get(name, {}).get(value)
    return np.concatenate(parts) if parts else np.empty(0, kind)


def probabilities(block: Block, row: dict, orders: list[Order], upto: int) -> tuple[Grams, np.ndarray]:
    """Distinct n-grams of order ``upto`` in a block and their probabilities, by recursion to lower orders."""
    grams = block.grams(upto)
    count = _answer(row, f"count{upto}", 0, np.int64) >> 1
    order = orders[upto - 1]
    kept = order.kept(count)
    if upto == 1:
        whole, unseen = order.unigrams
        return grams, np.where(count > 0, kept / whole, unseen)
    lower, below = probabilities(block, row, orders, upto - 1)
    history = np.unique(grams.history, return_inverse=True)[1]
    whole, weight = (_answer(row, f"back{upto}", v, np.float64)[history] for v in (0, 1))
    return grams, np.where(count > 0, kept / np.maximum(whole, 1), weight * below[lower.of_token[grams.first]])


HELD = ["doc_ids", "held", "sizes", "places", "words"]  # what a block's own row has


def _with_answers(blocks: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of blocks and of the answers to them, a block's own first and the answers by table and bucket.

    They stay rows of bounded size, which a task reads one after the other; no block's answers
    are gathered into a value.
    """
    rows = blocks.select("block", F.lit("").alias("kind"), F.lit(-1).cast("long").alias("bucket"),
                         F.lit(None).cast("array<binary>").alias("answer"), *HELD)
    own = dict(blocks.dtypes)
    for name, table in tables.items():
        rows = rows.union(table.where("block IS NOT NULL").select(
            "block", F.lit(name), "bucket", "answer", *(F.lit(None).cast(own[c]) for c in HELD)))
    return rows.repartition("block").sortWithinPartitions("block", "kind", "bucket") if tables else rows


def _answered_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A block's row with the decoded answers of each table, piece by piece: table -> value -> arrays."""
    row: dict = {}
    for batch in batches:
        names, kinds = batch.column("block").to_pylist(), batch.column("kind").to_pylist()
        for k, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            if not kind:
                if row:
                    yield row
                row = {c: batch.column(c)[k].as_py() for c in HELD} | {"block": name}
                continue
            pieces = row.setdefault(kind, {})
            for value, data in enumerate(batch.column("answer")[k].values):
                form = np.int64 if kind.startswith("count") else np.float64
                pieces.setdefault(value, []).append(_grow(data.as_buffer(), form))
    if row:
        yield row


def score_texts(docs: DataFrame, held: str = "held", order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of all texts under a model learned from the rows that are not ``held``.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one
    unigrams) and score (the Katz model). ASCII letters are lowered; tokens are runs of
    non-space bytes and one end per text, so null and empty texts have one token. A word
    never seen in training has the probability that discounting leaves over. If no row
    is learned from, counts are zero and every token has that of an unseen word. Rows
    that repeat an id stay rows of their own; other columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(held).alias("held"))
    blocks = materialize(rows.mapInArrow(_blocks, "block long, doc_ids array<long>, held array<boolean>, sizes array<int>, "
                                                  "places binary, words binary"), "katz-blocks")
    buckets = max(1, blocks.count())  # a bucket has about as many entries as a block, however many there are
    tables: dict[str, DataFrame] = {}
    orders: list[Order] = []

    for k in range(1, order + 1):
        def send_counts(row: dict, k: int = k) -> tuple[np.ndarray, list[np.ndarray]]:
            block = Block(row)
            grams = block.grams(k)
            return grams.keys, [np.bincount(grams.of_token, block.learned, len(grams.keys)).astype(np.int32)]

        tables[f"count{k}"] = exchange(_with_answers(blocks, {}), buckets, send_counts, _count, (np.int32,), f"katz-count{k}")
        orders.append(summary(tables[f"count{k}"]))
        if k > 1:
            def send_histories(row: dict, k: int = k, known: tuple[Order, ...] = tuple(orders)) -> tuple[np.ndarray, list[np.ndarray]]:
                block = Block(row)
                grams = block.grams(k)
                keys, history = np.unique(grams.history, return_inverse=True)
                answer = _answer(row, f"count{k}", 0, np.int64)
                own, count = (answer & 1).astype(bool), answer >> 1
                lower, below = probabilities(block, row, list(known), k - 1)
                sums = [np.bincount(history[own], x[own], len(keys)) for x in (
                    count.astype(float), known[k - 1].kept(count), below[lower.of_token[grams.first]])]
                return keys, sums

            tables[f"back{k}"] = exchange(_with_answers(blocks, tables), buckets, send_histories, _weigh, (np.float64,) * 3, f"katz-back{k}")

    known = tuple(orders)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _answered_blocks(batches):
            block = Block(row)
            grams, probability = probabilities(block, row, list(known), order)
            words = block.grams(1)
            count = (_answer(row, "count1", 0, np.int64) >> 1)[words.of_token]
            plain = np.log10((count + 1) / (known[0].tokens + known[0].types + 1))
            sums = [np.add.reduceat(x, block.starts) for x in (plain, np.log10(probability)[grams.of_token])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.doc_ids, pa.int64()), pa.array(block.held), pa.array(block.sizes, pa.int64()),
                 pa.array(np.add.reduceat((count > 0).astype(np.int64), block.starts)),
                 pa.array(np.full(len(block.sizes), known[0].tokens)), *map(pa.array, sums)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _with_answers(blocks, tables).mapInArrow(
        evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def katz_scores(docs: DataFrame) -> DataFrame:
    """The contract's held-out rows and columns."""
    return score_texts(docs.select("doc_id", "text", held_out(F.col("doc_id"), 7).alias("held")))
