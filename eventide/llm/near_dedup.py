"""MinHash near-duplicates with sequential Bayesian verification.

Signatures are cut into bands; documents that share a band are candidates. A
candidate's signature is compared batch by batch and dropped as soon as the
posterior probability of reaching the similarity is below the miss probability.
Survivors are verified on their full shingle sets. Candidates inside a band are
first compared with one centre, so a group of copies costs about one comparison
each. Bands whose documents are still in different components are then compared
in full, but only across components; both steps keep every link that matters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import byte_texts, components, hash_words, key_runs, mix, window_hashes
from eventide.session import materialize

WIDTH = 5  # words of a shingle
PERCENT = 85  # default similarity of a link, in hundredths
HASHES = 80  # minimum hashes of a signature
BAND = 4  # hashes of a band: a pair at 0.85 misses all twenty with probability 4e-7, one at 0.80 with 3e-5
STEP = 16  # hashes compared at once
MISS = 1e-6  # posterior below which a candidate is dropped
PART = 512  # larger bands are compared in pairs of parts of about this size
CHUNK = 1 << 20  # bytes of text hashed at once in a task


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; shorter texts are one shingle, empty ones none."""
    words = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = hash_words([w for ws in words for w in ws])
    whole = window_hashes(flat, WIDTH)
    out, at = [], 0
    for n in sizes:
        if n >= WIDTH:
            out.append(np.unique(whole[at:at + n - WIDTH + 1]))
        else:
            out.append(window_hashes(flat[at:at + n], n) if n else np.empty(0, np.uint64))
        at += n
    return out


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def signatures(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """Minimum of each hash function over each non-empty set."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    flat = np.concatenate(sets)
    rng = np.random.default_rng(20_24)
    odd = rng.integers(0, 2**63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, hashes, np.uint64)
    out = np.empty((len(sets), hashes), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(hashes):
            out[:, k] = np.minimum.reduceat((flat * odd[k] + plus[k]) >> np.uint64(32), starts)
    return out


def _print_of(s: np.ndarray) -> int:
    """The 64-bit name of a shingle set, as a signed integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


SKETCH = "doc_id long, n_shingles long, node long, sig binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("sig", pa.binary())])
    for batch in batches:
        texts = byte_texts(batch.column("text"))
        ids = batch.column("doc_id")
        for lo, hi in chunks(texts):
            sets = shingle_sets(texts[lo:hi])
            full = [s for s in sets if len(s)]
            sigs = iter(signatures(full) if full else [])
            nodes = [_print_of(s) if len(s) else None for s in sets]
            packed = [next(sigs).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(nodes, pa.int64()), pa.array(packed, pa.binary())], schema=schema)


def least_matches(percent: int = PERCENT, hashes: int = HASHES, miss: float = MISS) -> list[int]:
    """Matches a candidate needs after each batch of hashes.

    Under a uniform prior the posterior after m matches of n is a Beta; its mass
    above t equals the probability of at most m successes in n + 1 draws at t.
    """
    t = percent / 100
    out = []
    for n in range(STEP, hashes + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append(m)
    return out


def bayes_survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Places of the rows of two signature tables that no batch of hashes rules out."""
    live = np.arange(len(b))
    matches = np.zeros(len(b), np.int64)
    for i, need in enumerate(least):
        cut = slice(i * STEP, (i + 1) * STEP)
        left = a[live, cut] if len(a) > 1 or len(b) == 1 else a[:, cut]
        matches = matches + (left == b[live, cut]).sum(axis=1)
        keep = matches >= need
        live, matches = live[keep], matches[keep]
    return live


def _sig_table(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), HASHES)


def _prune(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    least = least_matches(percent)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                live = bayes_survivors(_sig_table(batch.column("sig_a")), _sig_table(batch.column("sig_b")), least)
                yield batch.select(["a", "b"]).take(pa.array(live))

    return prune


def _across(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of one band that join documents of different components.

    Signatures are compared first and survivors verified on the full sets; documents
    that a link has joined are not compared again, so at most one link a document
    comes out.
    """
    least = least_matches(percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for run in key_runs(batches, ["key", "i", "j"]):
        label, n = run.column("label").to_numpy(), run.column("n_shingles").to_numpy()
        if (label == label[0]).all():
            continue
        node, part = run.column("node").to_numpy(), run.column("part").to_numpy()
        i, j = run.column("i")[0].as_py(), run.column("j")[0].as_py()
        sigs = _sig_table(run.column("sig"))
        _, at = np.unique(np.frombuffer(b"".join(run.column("shingles").to_pylist()), np.uint64), return_inverse=True)
        edges = np.append(0, np.cumsum(n))
        group = np.unique(label, return_inverse=True)[1]
        for x in range(len(node)):
            if i != j and part[x] != i:
                continue
            others = np.arange(x + 1, len(node)) if i == j else np.flatnonzero(part == j)
            near = 100 * np.minimum(n[others], n[x]) >= percent * np.maximum(n[others], n[x])
            others = others[near & (group[others] != group[x])]
            if not len(others):
                continue
            others = others[bayes_survivors(sigs[x:x + 1], sigs[others], least)]
            if not len(others):
                continue
            own = np.zeros(at.max() + 1, bool)
            own[at[edges[x]:edges[x + 1]]] = True
            both = np.array([own[at[edges[y]:edges[y + 1]]].sum() for y in others])
            joined = []
            for y in others[100 * both >= percent * (n[x] + n[others] - both)]:
                if group[y] != group[x]:
                    group[group == group[y]] = group[x]
                    joined.append(y)
            if joined:
                yield pa.RecordBatch.from_arrays([pa.array([node[x]] * len(joined), pa.int64()),
                                                  pa.array(node[joined], pa.int64())], schema=schema)


def _fetch_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of the asked documents, where the text is the one asked for."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        texts = byte_texts(batch.column("text"))
        asked = batch.column("node").to_pylist()
        for lo, hi in chunks(texts):
            sets = shingle_sets(texts[lo:hi])
            own = [(asked[lo + k], s.tobytes()) for k, s in enumerate(sets)
                   if len(s) and _print_of(s) == asked[lo + k]]
            if own:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.binary())], schema=schema)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def fetch(docs: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """Shingle sets (node, shingles) of the asked nodes, from the texts that stand for them."""
    reps = asked.join(nodes.select("node", F.col("rep").alias("doc_id")), "node")
    return docs.join(reps, "doc_id").select("node", "text").mapInArrow(_fetch_sets, "node long, shingles binary")


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full shingle sets reach the similarity."""
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = fetch(docs, nodes, asked)
    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
            .select("a", "b", "set_a", "set_b").mapInArrow(lambda rows: _confirm(rows, percent), "a long, b long"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Links are pairs with ``100 * intersection >= percent * union`` of their shingle sets;
    a component is named by its smallest id, whose row is the one kept. Null and
    empty texts have no shingles and stay alone, and so does a row without an id
    (its component is null, and it is kept). Rows that repeat an id stay rows of
    their own. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = materialize(docs.mapInArrow(_sketch, SKETCH), "sketches")
    usable = sketch.where("node IS NOT NULL AND doc_id IS NOT NULL")
    # equal sets are one node; its smallest document stands for it
    nodes = materialize(usable.groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "nodes")
    bands = nodes.select("node", F.explode(F.array(*[
        F.xxhash64(F.lit(k), F.substring("sig", k * BAND * 4 + 1, BAND * 4)) for k in range(HASHES // BAND)])).alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(bands.join(buckets, "key"), "shared-bands")

    sized = nodes.select("node", "n_shingles", "sig")
    first = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    near = (first.join(sized.toDF("a", "n_a", "sig_a"), "a").join(sized.toDF("b", "n_b", "sig_b"), "b")
            .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    pairs = materialize(near.select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(percent), "a long, b long"), "pairs")
    links = materialize(verify(docs, nodes, pairs, percent), "links")
    labels = components(links, "near")

    # what a centre did not join: only pairs of one band in different components are left
    placed = (shared.where("size > 2").join(labels, "node", "left")
              .withColumn("label", F.coalesce("label", "node")))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    left = materialize(placed.where("node <> centre").join(mixed.select("key"), "key"), "mixed-bands")
    apart = (left.join(sized, "node").join(fetch(docs, nodes, left.select("node").distinct()), "node")
             .withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
             .withColumn("part", F.pmod(F.hash("node"), "parts"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")))
    more = materialize(
        apart.select("key", "i", "j", "node", "label", "part", "n_shingles", "sig", "shingles").repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j").mapInArrow(lambda rows: _across(rows, percent), "a long, b long").distinct(), "late-links")
    if not more.isEmpty():
        labels = components(links.union(more), "near")

    named = sketch.select("doc_id", "n_shingles", "node").join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node")).alias("label"))
    linked = named.where("label IS NOT NULL")
    smallest = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    columns = ["doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    alone = named.where("label IS NULL").withColumn("component_id", F.col("doc_id"))
    return linked.join(smallest, "label").select(*columns).union(alone.select(*columns))
