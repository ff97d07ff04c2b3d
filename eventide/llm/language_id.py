"""Languages of a text as a mixture, inferred by expectation-maximisation.

Each language is a distribution over hashed character trigrams, counted over all
training documents. A word's likelihood under a language is the product over its
letters. The proportions of the languages in a document are those that maximise
the likelihood of its words; how many languages a document is taken to hold is
decided by a penalised likelihood over the nested sets of its largest ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import held_out
from eventide.llm.letters import chunks, gram_buckets, letters

BITS = 16
SMOOTH = 0.05  # added to every bucket's count
PENALTY = 3.0  # per further language, times the log of the number of words
ROUNDS = 8
MAX_LANGUAGES = 512  # a model of more would not fit beside the data; fitting then fails
UNDETERMINED = "und"


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the trigrams around each letter, the letters' texts, and where words begin."""
    points, text_of = letters(texts)
    middle = np.flatnonzero(points != 32)
    first = np.flatnonzero(points[middle - 1] == 32)
    return gram_buckets(points, middle - 1, 3, BITS), text_of[middle], first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lo, hi in chunks(texts):
            buckets, text_of, _ = _trigrams(texts[lo:hi])
            names = sorted(set(langs[lo:hi]))
            which = np.array([names.index(x) for x in langs[lo:hi]])[text_of]
            table = np.bincount(which << BITS | buckets, minlength=len(names) << BITS).reshape(len(names), -1)
            for k, name in enumerate(names):
                counts[name] = counts.get(name, 0) + table[k]
    for name, row in counts.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()),
                                          pa.array(row[some], pa.int64())], names=["lang", "bucket", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and the log probabilities (buckets x languages) of their trigrams.

    ``docs`` holds the training rows' text and lang; rows lacking either, or
    without a letter, teach nothing. The tables brought to the driver have one row
    per language and bucket, however large the corpus.
    """
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counted = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("rows"))
    found = rows.limit(MAX_LANGUAGES + 1).toArrow()
    if found.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = found.column("lang").to_pylist()
    order = sorted(range(len(langs)), key=langs.__getitem__)
    table = np.full((1 << BITS, max(1, len(langs))), SMOOTH)
    for k, i in enumerate(order):
        pairs = found.column("rows")[i].values
        table[pairs.field("bucket").to_numpy(), k] += pairs.field("n").to_numpy()
    return [langs[i] for i in order], np.log(table / table.sum(axis=0)).astype(np.float32)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


def mixtures(word_logs: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
             most: int | None = None, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """Language proportions of each document and a score of the largest one.

    Nested sets grow until none of more languages can reach a better penalised
    likelihood in any of the documents, by a bound on the likelihood of all mixtures; ``most`` ends them earlier.

    ``word_logs``: log likelihood of each word under each language; documents are
    the runs of ``sizes`` words beginning at ``starts``.
    """
    docs, langs = len(starts), word_logs.shape[1]
    peak = word_logs.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(word_logs - peak, -60.0))
    doc_of = np.repeat(np.arange(docs), sizes)

    def em(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Improved shares and the log likelihood they were improved from."""
        level = np.zeros(docs)
        for _ in range(rounds):
            weighed = like * share[doc_of]
            total = weighed.sum(axis=1)
            level = _sums(np.log(total), starts)
            share = _sums(weighed / total[:, None], starts) / sizes[:, None]
        return share, level

    single = _sums(np.maximum(word_logs - peak, -60.0), starts)
    best = single.argmax(axis=1)
    shares = np.zeros((docs, langs), np.float32)
    shares[np.arange(docs), best] = 1.0
    odds = np.exp(single - single.max(axis=1, keepdims=True))
    score = odds[np.arange(docs), best] / odds.sum(axis=1)
    if langs == 1:
        return shares, score
    level = single[np.arange(docs), best]
    full, _ = em(np.full((docs, langs), 1.0 / langs, np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1, kind="stable")
    # log likelihood is concave: no mixture exceeds that of ``full`` by more than its gradient allows
    total = (like * full[doc_of]).sum(axis=1)
    slope = _sums(like / total[:, None], starts).max(axis=1) / sizes
    top = _sums(np.log(total), starts) + sizes * np.log(np.maximum(slope, 1.0))
    top = np.minimum(top + 1e-4 * (1.0 + np.abs(top)), 0.0)
    for k in range(2, min(most or langs, langs) + 1):
        if (top - penalty * (k - 1) * np.log(sizes + 1.0) <= level).all():
            break
        part = np.where(rank < k, np.maximum(full, 1e-6), 0.0).astype(np.float32)
        part, reached = em(part / part.sum(axis=1, keepdims=True), 3)
        better = reached - penalty * (k - 1) * np.log(sizes + 1.0) > level
        level = np.where(better, reached - penalty * (k - 1) * np.log(sizes + 1.0), level)
        shares[better] = part[better]
        score = np.where(better, part.max(axis=1), score)
    return shares, np.clip(score, 0.0, 1.0)


def identify(docs: DataFrame, langs: list[str], logs: np.ndarray, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and mixture ("de:0.62,en:0.38") per document.

    The prediction is the language of the largest share. A null text and one without
    letters is ``und`` with score 0, and so is every text if no language was learned.
    Rows that repeat an id stay rows of their own; other columns are ignored.
    """
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in chunks(texts):
                pred, score, mixed = [UNDETERMINED] * (hi - lo), np.zeros(hi - lo), [""] * (hi - lo)
                buckets, text_of, first = _trigrams(texts[lo:hi])
                if langs and len(first):
                    words = _sums(logs[buckets], first)
                    starts = np.flatnonzero(np.diff(text_of[first], prepend=-1))
                    sizes = np.diff(starts, append=len(first))
                    shares, level = mixtures(words, starts, sizes)
                    for row, i in enumerate(text_of[first][starts]):
                        top = shares[row].argmax()
                        pred[i], score[i] = langs[top], level[row]
                        held = np.flatnonzero(shares[row] > 0.005)
                        held = held[np.argsort(-shares[row][held], kind="stable")]
                        mixed[i] = ",".join(f"{langs[k]}:{shares[row][k]:.2f}" for k in held)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo),
                     pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.string())],
                    names=["doc_id", "held_out", "lang_pred", "score", "mixture"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), 4).alias("held_out"),
                       F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, mixture string")


def language_id(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out, then identify every row."""
    langs, logs = fit(docs.where(~held_out(F.col("doc_id"), 4)))
    return identify(docs, langs, logs)
