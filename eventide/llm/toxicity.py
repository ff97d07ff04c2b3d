"""A toxicity score by a logistic model that is penalised for reacting to identity terms.

Features are hashed words and character five-grams inside words. Those whose
document frequency differs between the labels are selected; their weights are
fitted with a penalty on the squared change of the score when an identity term of a
labelled text is swapped for another of its group, so that a neutral mention of a
group does not raise the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import held_out
from eventide.llm.letters import chunks, gram_buckets, letters
from eventide.session import materialize

BITS = 20
THRESHOLD = 0.3

#: Terms of one group can stand for each other in a sentence.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("disabled", "blind", "deaf"), ("old", "young"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("femme", "homme"), ("mujer", "hombre"), ("frau", "mann"),
)


@dataclass(frozen=True)
class Training:
    """``sample`` bounds the labelled rows that are fitted on (about; chosen by a hash of the id)."""

    sample: int = 20_000
    least_z: float = 3.0  # standard errors by which a feature's frequency must differ
    ridge: float = 1.0
    fairness: float = 20.0  # weight of the squared score change of a swap
    rounds: int = 400
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs."""
    points, text_of = letters(texts)
    word_end = points == 32
    firsts = np.flatnonzero(~word_end[1:] & word_end[:-1]) + 1
    if not len(firsts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # a word's hash: the sum over its letters of a hash of letter and place
    place = np.arange(len(points)) - np.repeat(np.r_[0, firsts], np.diff(np.r_[0, firsts, len(points)]))
    with np.errstate(over="ignore"):
        h = (points + np.uint64(0x10FFFF) * place.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        sums = np.add.reduceat(np.where(word_end, np.uint64(0), h), firsts) * np.uint64(0x9E3779B97F4A7C15)
    words = (sums >> np.uint64(64 - BITS)).astype(np.int64)
    inside = ~(word_end[1:-3] | word_end[2:-2] | word_end[3:-1])
    grams = np.flatnonzero(inside)
    pair = np.concatenate([text_of[firsts].astype(np.int64) << BITS | words,
                           text_of[grams + 1].astype(np.int64) << BITS | gram_buckets(points, grams, 5, BITS)])
    pair = np.unique(pair)
    return pair >> BITS, pair & ((1 << BITS) - 1)


def _swap_pattern(groups: Sequence[Sequence[str]]) -> re.Pattern:
    return re.compile(r"\b(" + "|".join(sorted({t for g in groups for t in g}, key=len, reverse=True)) + r")\b", re.I)


def swapped(text: str, groups: Sequence[Sequence[str]]) -> list[str]:
    """Copies of the text with every identity term replaced by the next ones of its group."""
    pattern = _swap_pattern(groups)
    if not pattern.search(text):
        return []
    place = {t: (g, i) for g in groups for i, t in enumerate(g)}
    turns = max(len(place[m.lower()][0]) for m in pattern.findall(text))

    def turned(k: int) -> str:
        def other(m: re.Match) -> str:
            group, i = place[m[0].lower()]
            return group[(i + k) % len(group)]
        return pattern.sub(other, text)
    return [turned(k) for k in range(1, turns)]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        texts, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_numpy()
        for lo, hi in chunks(texts):
            doc, bucket = features(texts[lo:hi])
            for y in (0, 1):
                counts[y] += np.bincount(bucket[toxic[lo:hi][doc] == y], minlength=1 << BITS)
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[0, some]), pa.array(counts[1, some])],
                                     names=["bucket", "n0", "n1"])


def select_features(sample: DataFrame, least_z: float) -> tuple[np.ndarray, int, int]:
    """Buckets whose frequencies differ between the labels, and the rows of each label."""
    n0, n1 = sample.agg(F.count_if(F.col("toxic") == 0), F.count_if(F.col("toxic") == 1)).first()
    if not n0 or not n1:
        return np.empty(0, np.int64), n0, n1
    share = (F.col("n0") + F.col("n1")) / F.lit(float(n0 + n1))
    z = (F.col("n1") / F.lit(float(n1)) - F.col("n0") / F.lit(float(n0))) / F.sqrt(
        share * (1 - share) * F.lit(1 / n0 + 1 / n1) + F.lit(1e-12))
    found = (sample.repartition(8).mapInArrow(_frequencies, "bucket int, n0 long, n1 long").groupBy("bucket")
             .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
             .where((F.abs(z) >= least_z) & (F.col("n0") + F.col("n1") >= 5)).select("bucket").toArrow())
    return np.sort(found.column("bucket").to_numpy()), n0, n1


def fit(sample: DataFrame, training: Training = Training()) -> tuple[np.ndarray, np.ndarray, float]:
    """Selected buckets, their weights and the intercept, from rows (text, toxic).

    The rows brought to the driver are the selected features of a sample whose size
    is bounded by ``Training.sample``.
    """
    chosen, n0, n1 = select_features(sample, training.least_z)
    if not n0 or not n1:
        return np.empty(0, np.int64), np.empty(0), (-30.0 if not n1 else 30.0)
    groups = training.groups

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
            for lo, hi in chunks(texts):
                own, owner = list(texts[lo:hi]), list(range(hi - lo))
                for k in range(hi - lo):
                    other = swapped(texts[lo + k], groups)
                    own += other
                    owner += [k] * len(other)
                doc, bucket = features(own)
                at = np.searchsorted(chosen, bucket)
                hit = (at < len(chosen)) & (np.take(chosen, at, mode="clip") == bucket)
                sets: list[list[int]] = [[] for _ in own]
                for d, f in zip(doc[hit], at[hit], strict=True):
                    sets[d].append(int(f))
                swaps: list[list[list[int]]] = [[] for _ in range(hi - lo)]
                for k in range(hi - lo, len(own)):
                    swaps[owner[k]].append(sets[k])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(toxic[lo:hi], pa.int32()), pa.array(sets[:hi - lo], pa.list_(pa.int32())),
                     pa.array(swaps, pa.list_(pa.list_(pa.int32())))], names=["toxic", "on", "swaps"])

    got = sample.mapInArrow(rows, "toxic int, on array<int>, swaps array<array<int>>").toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    on, swaps = got.column("on").to_pylist(), got.column("swaps").to_pylist()
    weights, intercept = train(y, on, [(a, b) for a, many in zip(on, swaps, strict=True) for b in many], len(chosen), training)
    return chosen, weights, intercept


def train(y: np.ndarray, on: list[list[int]], pairs: list[tuple[list[int], list[int]]], n: int,
          training: Training) -> tuple[np.ndarray, float]:
    """Accelerated gradient steps on log loss + ridge + squared score change over the pairs."""
    row = np.repeat(np.arange(len(on)), [len(x) for x in on])
    col = np.array([f for x in on for f in x], np.int64)
    change = [sorted(set(a) ^ set(b)) for a, b in pairs]
    p_row = np.repeat(np.arange(len(change)), [len(x) for x in change])
    p_col = np.array([f for x in change for f in x], np.int64)
    p_sign = np.array([1.0 if f in b else -1.0 for (_, b), x in zip([(set(a), set(b)) for a, b in pairs], change, strict=True)
                       for f in x])
    prior = y.mean()
    w, intercept = np.zeros(n), float(np.log(prior / (1 - prior)))
    longest = max([1, *map(len, on)])
    tail = max([0, *map(len, change)])
    # a bound of the curvature of every coordinate block, by row sums
    load = np.bincount(col, minlength=n) if n else np.zeros(0)
    p_load = np.bincount(p_col, minlength=n) if n else np.zeros(0)
    step = 1.0 / (training.ridge + 0.25 * load * longest**0.5 * 2 + training.fairness * p_load * max(tail, 1))
    step0 = 4.0 / len(y)
    ahead, ahead0, prev, prev0 = w.copy(), intercept, w.copy(), intercept
    for t in range(1, training.rounds + 1):
        z = ahead0 + np.bincount(row, ahead[col], len(y)) if len(col) else np.full(len(y), ahead0)
        gap = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        grad = training.ridge * ahead
        if len(col):
            grad = grad + np.bincount(col, gap[row], n)
        if len(p_col):
            moved = np.bincount(p_row, ahead[p_col] * p_sign, len(change))
            grad = grad + training.fairness * np.bincount(p_col, moved[p_row] * p_sign, n)
        w, intercept = ahead - step * grad, ahead0 - 0.5 * step0 * gap.sum()
        momentum = (t - 1) / (t + 2)
        ahead, ahead0 = w + momentum * (w - prev), intercept + momentum * (intercept - prev0)
        prev, prev0 = w, intercept
    return w, float(intercept)


def score(docs: DataFrame, chosen: np.ndarray, weights: np.ndarray, intercept: float,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted per document; null and empty texts score by the intercept."""
    table = np.zeros(1 << BITS, np.float32)
    table[chosen] = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in chunks(texts):
                doc, bucket = features(texts[lo:hi])
                z = intercept + np.bincount(doc, table[bucket].astype(float), hi - lo)
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo),
                     pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), 4).alias("held_out"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def labelled_sample(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """Texts and labels of about ``training.sample`` labelled rows that are not held out.

    Labels of one id are merged to the largest. The chosen ids are at most about the
    bound, so they are broadcast to the documents.
    """
    usable = (labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"), 4))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    share = training.sample / max(1, usable.count())
    picked = usable.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * share))
    return materialize(docs.join(F.broadcast(picked), "doc_id").where("text IS NOT NULL").select("text", "toxic"), "toxic-sample")


def toxicity(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> DataFrame:
    """Fit on a bounded labelled sample outside the held-out rows, then score every row.

    Without a label, or with labels of one kind only, every score is (nearly) that
    kind's, and 0 without any. Rows that repeat an id stay rows of their own; other
    columns are ignored; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    return score(docs, *fit(labelled_sample(docs, labels, training), training))
