"""Near-duplicate vectors of one label by an inverted multi-index.

Each half of the unit vectors has its own codebook; a pair of codes is a cell of the
product grid. A vector visits cells in order of its summed distance to the two codes
(multi-sequence order) until the share of near neighbours reached, measured on a
fitted sample, meets the target. Vectors of visited cells are verified by their
cosine. A pair counts when either of its vectors visits the other's cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import components, key_runs
from eventide.session import materialize


@dataclass(frozen=True)
class Index:
    """``sample`` bounds the vectors that codebooks and visits are fitted on; all are indexed."""

    cosine: float = 0.98
    recall: float = 0.999
    sample: int = 4096
    per_cell: float = 32.0  # vectors wanted in a cell of a label's grid
    most_codes: int = 256
    part: int = 2048  # larger cells are compared in parts of about this size


def _unit(batch_rows: list[list[float]]) -> np.ndarray:
    x = np.array(batch_rows, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable():
    """Whether a row (vec_id, vec, label) can link: an id, a label, only finite components, not all zero."""
    v = F.col("vec")
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        v, lambda x: x != 0.0)
    return F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :x.shape[1] // 2], x[:, x.shape[1] // 2:]


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's iterations from evenly spread rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(axis=1)
        for c in np.unique(near):
            centres[c] = x[near == c].mean(axis=0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1)[None, :]


def cell_order(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], visits: int) -> np.ndarray:
    """The nearest ``visits`` cells of each vector.

    A cell among the nearest T has codes ranked r and s in its halves with
    (r + 1)(s + 1) <= T, as all cells of smaller ranks come first; only those are sorted.
    """
    a, b = _halves(x)
    da, db = _distances(a, books[0]), _distances(b, books[1])
    visits = min(visits, da.shape[1] * db.shape[1])
    oa, ob = np.argsort(da, axis=1, kind="stable"), np.argsort(db, axis=1, kind="stable")
    ranks = [(r, s) for r in range(min(visits, da.shape[1])) for s in range(min(visits // (r + 1), db.shape[1]))]
    r, s = np.array(ranks).T
    sums = np.take_along_axis(da, oa, 1)[:, r] + np.take_along_axis(db, ob, 1)[:, s]
    first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
    return np.take_along_axis(oa[:, r] * db.shape[1] + ob[:, s], first, 1)


def needed_visits(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], index: Index) -> int:
    """Cells to visit so that ``recall`` of neighbours at exactly the cosine are reached.

    Neighbours are made from the sample: each vector turned by the limiting angle in
    a random direction, which is the farthest a link can be.
    """
    rng = np.random.default_rng(7)
    reps = max(1, 4096 // len(x))
    base = np.repeat(x, reps, axis=0)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    other = index.cosine * base + np.sqrt(1 - index.cosine**2) * side
    home = cell_order(other, books, 1)[:, 0]
    most = len(books[0]) * len(books[1])
    visits = 16
    while True:
        order = cell_order(base, books, visits)
        reached = (order == home[:, None])
        share = reached.any(axis=1).mean()
        if share >= index.recall or visits >= most:
            rank = np.where(reached.any(axis=1), reached.argmax(axis=1), visits - 1)
            return int(np.quantile(rank, min(1.0, index.recall), method="higher")) + 1
        visits *= 2


def fit(vectors: DataFrame, index: Index) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[int, int]]:
    """Codebooks and visits by the number of codes a label asks for, from one bounded sample.

    Labels of similar size share a grid: the number of codes is a power of two that
    grows with the square root of the label's vectors.
    """
    sizes = vectors.groupBy("label").count().select(_codes(F.col("count"), index).alias("codes")).distinct()
    wanted = sorted(r.codes for r in sizes.collect())  # powers of two up to most_codes
    total = vectors.count()
    keep = int(1_000_000 * min(1.0, index.sample / max(1, total)))
    rows = (vectors.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1_000_000)) < keep).select("vec_id", "vec")
            .orderBy("vec_id").limit(2 * index.sample).toArrow().column("vec").to_pylist())
    by_width: dict[int, list[list[float]]] = {}
    for row in rows:
        by_width.setdefault(len(row), []).append(row)
    books, visits = {}, {}
    for width, own in by_width.items():
        x = _unit(own)
        for k in wanted:
            a, b = _halves(x)
            n = min(k, len(x))
            books[width, k] = (codebook(a, n), codebook(b, n))
            visits[width, k] = needed_visits(x, books[width, k], index)
    return books, visits


def _codes(count, index: Index):
    """Codes of a half: a power of two near the square root of the cells wanted."""
    root = F.sqrt(F.greatest(count / F.lit(index.per_cell), F.lit(1.0)))
    return F.least(F.lit(index.most_codes), F.greatest(F.lit(2), F.pow(F.lit(2.0), F.round(F.log2(root))))).cast("int")


def near_vectors(vectors: DataFrame, index: Index = Index(), id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and their cosine in double precision is
    at least ``index.cosine``. A null label, and vectors that are null, empty, zero or
    hold null or non-finite components, link with nothing. Vectors of different
    lengths never link. Equal vectors of a label are indexed once; each counts all its
    copies. Rows that repeat an id are copies like any others. A row without an id does
    not link: its component is null and it is kept. Extra columns are ignored; an empty
    table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    live = materialize(rows.where(usable()).withColumn("node", F.xxhash64("label", F.transform(
        "vec", lambda x: x + F.lit(0.0)))), "vectors")
    nodes = live.groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"),
                                     F.min("vec_id").alias("vec_id"))
    nodes = materialize(nodes, "distinct-vectors")
    books, visits = fit(nodes, index)
    sized = nodes.join(nodes.groupBy("label").agg(_codes(F.count(F.lit(1)), index).alias("codes")), "label")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's own cell and the cells it visits."""
        for batch in batches:
            vecs, codes = batch.column("vec").to_pylist(), batch.column("codes").to_pylist()
            cells: list[list[int]] = [[]] * len(vecs)
            home: list[list[int]] = [[]] * len(vecs)
            groups: dict[tuple[int, int], list[int]] = {}
            for i, (v, k) in enumerate(zip(vecs, codes, strict=True)):
                groups.setdefault((len(v), k), []).append(i)
            for (width, k), own in groups.items():
                x = _unit([vecs[i] for i in own])
                if (width, k) in books:
                    order = cell_order(x, books[width, k], visits[width, k])
                else:  # a length the sample did not hold: one cell
                    order = np.zeros((len(own), 1), np.int64)
                for i, line in zip(own, order.tolist(), strict=True):
                    cells[i], home[i] = line, [width, line[0]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("node", "label", "vec", "copies")]
                + [pa.array([h[0] for h in home], pa.int32()), pa.array([h[1] for h in home], pa.int32()),
                   pa.array(cells, pa.list_(pa.int32()))],
                names=["node", "label", "vec", "copies", "width", "home", "cells"])

    types = dict(nodes.dtypes)
    placed = materialize(sized.select("node", "label", "vec", "copies", "codes").mapInArrow(
        place, f"node long, label {types['label']}, vec {types['vec']}, copies long, width int, home int, cells array<int>"), "placed")
    grid = ["label", "width", "cell"]
    base = placed.withColumn("cell", F.col("home"))
    visiting = placed.withColumn("cell", F.explode("cells"))
    size = F.ceil(F.count(F.lit(1)) / index.part).cast("int")
    # both sides of a cell are dealt into parts; a group is one part of each
    parts = base.groupBy(*grid).agg(size.alias("parts")).join(
        visiting.select(*grid).groupBy(*grid).agg(size.alias("probe_parts")), grid)
    row = [*grid, "part", "probe_part", "node", "vec", "copies", "home"]
    stored = (base.join(parts, grid).withColumn("part", F.pmod(F.hash("node"), "parts"))
              .withColumn("probe_part", F.explode(F.sequence(F.lit(0), F.col("probe_parts") - 1))).select(*row, "cells"))
    probes = (visiting.join(parts, grid).withColumn("probe_part", F.pmod(F.hash("node"), "probe_parts"))
              .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select(*row, F.lit(None).cast("array<int>").alias("cells")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per cell: each vector's newly linked copies, and the smallest node it is joined to here."""
        for run in key_runs(batches, [*grid, "part", "probe_part"]):
            seen = run.column("cells").to_pylist()
            s = np.array([i for i, c in enumerate(seen) if c is not None], np.int64)
            q = np.array([i for i, c in enumerate(seen) if c is None], np.int64)
            if not len(s) or not len(q):
                continue
            node, copies, home = (run.column(c).to_numpy() for c in ("node", "copies", "home"))
            x = _unit(run.column("vec").to_pylist())
            visited = np.array([seen[i] for i in s], np.int64)
            for lo in range(0, len(q), 512):
                some = q[lo:lo + 512]
                i, j = np.nonzero(x[some] @ x[s].T >= index.cosine)
                i, j = i[node[some[i]] != node[s[j]]], j[node[some[i]] != node[s[j]]]
                if not len(i):
                    continue
                a, b = some[i], s[j]
                # a pair that both vectors find is counted where the smaller one probes
                once = (node[a] < node[b]) | ~(visited[j] == home[a][:, None]).any(axis=1)
                more = np.bincount(a[once], copies[b[once]], len(node)) + np.bincount(b[once], copies[a[once]], len(node))
                root = node.copy()
                while True:
                    before = root.copy()
                    np.minimum.at(root, a, root[b])
                    np.minimum.at(root, b, root[a])
                    if (root == before).all():
                        break
                hit = np.unique(np.concatenate([a, b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[hit], pa.int64()), pa.array(more[hit].astype(np.int64)), pa.array(root[hit], pa.int64())],
                    names=["node", "n", "root"])

    links = materialize(stored.union(probes).repartition(*grid, "part", "probe_part").sortWithinPartitions(
        *grid, "part", "probe_part").mapInArrow(
        compare, "node long, n long, root long"), "vector-links")
    counted = links.groupBy("node").agg(F.sum("n").alias("others"))
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "vectors")
    summed = (nodes.select("node", "copies", F.col("vec_id").alias("least")).join(counted, "node", "left").join(labels, "node", "left")
              .select("node", "least", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                      F.coalesce("label", "node").alias("component")))
    first = summed.groupBy("component").agg(F.min("least").alias("component_id"))
    per_node = materialize(summed.join(first, "component").select("node", "n_links", "component_id"), "vector-nodes")
    linked = live.select("vec_id", "node").join(per_node, "node").select("vec_id", "n_links", "component_id")
    rest = (rows.where(~usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return linked.union(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
