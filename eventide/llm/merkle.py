"""Merkle manifest of a dataset: one tree per source, and one over the sources' roots.

A level is one grouped pivot: conditional aggregates spread the children of a parent into
one column per slot; the concatenated columns hash to the parent, and the columns without
a child's own slot are that child's siblings. Going down again, a parent's way to the root
is joined to its pivot row and given to every child with the child's siblings before it.

Digests travel as bytes and are hashed as lowercase hex text. Parents are keyed by source
and position, so a source that holds most rows is dealt like any other, and a level has a
third of the rows of the one below. Every level is written once and used in both directions.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.common import numbered
from eventide.session import materialize

FANOUT = 3
CUT = 4  # levels that go down in one plan
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:binary,after:binary>"


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 of the fields one after the other: ``-`` for null, else UTF-8 byte count, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    return _hashed(F.concat(*(
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


@dataclass(frozen=True)
class Tree:
    """Leaves (key, pos, size, slot) and one table of pivoted parents per level, lowest first."""

    leaves: DataFrame
    levels: list[DataFrame]
    fanout: int

    def roots(self) -> DataFrame:
        """key and digest of the node that remains of each key."""
        ends = [self.leaves.select("key", "size", F.col("slot.digest").alias("digest")), *self.levels]
        found = [level.where("size = 1").select("key", "digest") for level in ends]
        out = found[0]
        for more in found[1:]:
            out = out.union(more)
        return out


@dataclass(frozen=True)
class Manifest:
    """The trees of the sources, the tree over their roots (names: key, id, digest), and the root (None: no rows)."""

    sources: Tree
    names: DataFrame
    top: Tree
    root: str | None


def build_tree(leaves: DataFrame, fanout: int = FANOUT) -> Tree:
    """All levels over numbered leaves (key, pos, size, slot); ``size`` nodes of a key are on a level."""
    most = leaves.agg(F.max("size")).first()[0] or 0
    levels: list[DataFrame] = []
    nodes = leaves
    while most > 1:
        slot = F.col("pos") % fanout
        columns = [F.max(F.when(slot == i, F.col("slot"))).alias(f"c{i}") for i in range(fanout)]
        joined = F.concat_ws("", *(_hex(F.col(f"c{i}.digest")) for i in range(fanout)))
        parents = (nodes.where("size > 1").groupBy("key", F.expr(f"pos div {fanout}").alias("pos"),
                                                   F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"))
                   .agg(*columns).withColumn("digest", _hashed(joined)))
        levels.append(materialize(parents, "merkle-level"))
        nodes = levels[-1].select("key", "pos", "size", F.struct("digest", F.lit(None).cast("bigint").alias("id"),
                                                                 F.lit(None).cast("binary").alias("bent")).alias("slot"))
        most = -(-most // fanout)
    return Tree(leaves, levels, fanout)


def _children(fanout: int) -> Column:
    """The filled slots of a pivot row: slot number, what it holds, and the columns beside it."""
    def beside(of: Iterable[int]) -> Column:
        found = [F.coalesce(F.col(f"c{i}.digest"), F.lit(b"")) for i in of]
        return F.concat(F.lit(b""), *found)
    return F.filter(F.array(*(
        F.struct(F.lit(i).alias("at"), F.col(f"c{i}").alias("slot"),
                 F.struct(beside(range(i)).alias("before"), beside(range(i + 1, fanout)).alias("after")).alias("step"))
        for i in range(fanout))), lambda c: c["slot"].isNotNull())


def ways(tree: Tree, from_roots: DataFrame) -> DataFrame:
    """Every leaf (slot) with its steps to the end, from the steps of each key's root (key, subroot, way)."""
    def ends(level: DataFrame) -> DataFrame:
        return level.where("size = 1").join(from_roots, "key")

    known = None
    for i, level in enumerate(reversed(tree.levels), 1):
        here = ends(level).select("key", "pos", "subroot", "way")
        known = here if known is None else known.drop("slot").union(here)
        known = (known.join(level.drop("size", "digest"), ["key", "pos"])
                 .select("key", "pos", "subroot", "way", F.explode(_children(tree.fanout)).alias("c"))
                 .select("key", (F.col("pos") * tree.fanout + F.col("c.at")).alias("pos"), "subroot",
                         F.concat(F.array(F.col("c.step")), F.col("way")).alias("way"), F.col("c.slot").alias("slot")))
        if i % CUT == 0 and i < len(tree.levels):
            known = materialize(known, "merkle-ways")
    lone = ends(tree.leaves).select("key", "pos", "subroot", "way", "slot")
    return lone if known is None else known.union(lone)


def merkle_manifest(docs: DataFrame, tampered: Column | None = None, fields: tuple[str, ...] = FIELDS,
                    group: str = "source", order: str = "doc_id", fanout: int = FANOUT) -> Manifest:
    """Trees over the leaves of each group in ``order``, and over the groups' roots in bytewise order.

    ``tampered`` is what the text of a row has become since, if a check is to be made against it
    (``fields[-1]`` is replaced by it). A null group comes first and is a group of its own; null
    ids come first. Rows that share an id are ordered by their digest; equal rows are leaves of
    their own. Null fields differ from empty ones. Other columns are ignored. Texts are hashed
    whole where they are read. An empty table has no root.
    """
    named = [F.col(f) for f in fields]
    digest = leaf_digest(named)
    bent = digest if tampered is None else leaf_digest([*named[:-1], tampered])
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("key"), F.col(order).cast("long").alias("id"),
                       digest.alias("digest"), bent.alias("bent"))
    leaves = materialize(
        numbered(rows, ["key"], ["id", "digest"], "merkle-leaves")
        .select("key", "pos", "size", F.struct("digest", "id", F.expr("CASE WHEN bent <> digest THEN bent END").alias("bent")).alias("slot")),
        "merkle-leaves")
    sources = build_tree(leaves, fanout)
    subroots = (numbered(sources.roots().withColumn("all", F.lit("")), ["all"], ["key"], "merkle-subroots")
                .select(F.col("all").alias("key"), "pos", "size", F.col("key").alias("name"), "digest"))
    subroots = materialize(subroots, "merkle-subroots")
    top = build_tree(subroots.select("key", "pos", "size", F.struct(
        "digest", F.col("pos").alias("id"), F.lit(None).cast("binary").alias("bent")).alias("slot")), fanout)
    end = top.roots().first()
    return Manifest(sources, subroots.select("name", F.col("pos").alias("id"), "digest"), top, end and end["digest"].hex())


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: slot (digest, id, bent), subroot, and the way: what stands before and after it, level by level to the root."""
    nothing = F.from_json(F.lit("[]"), f"array<{STEP}>")
    start = manifest.top.roots().select("key", F.lit(b"").alias("subroot"), nothing.alias("way"))
    sources = (ways(manifest.top, start).select(F.col("slot.id").alias("id"), "way").join(manifest.names, "id")
               .select(F.col("name").alias("key"), F.col("digest").alias("subroot"), "way"))
    return ways(manifest.sources, materialize(sources, "merkle-sources")).select("slot", "subroot", "way")


def folded(digest: Column, way: Column) -> Column:
    """The root that follows from a leaf's digest and its way, in lowercase hex."""
    return F.aggregate(way, _hex(digest), lambda own, step: F.sha2(
        F.concat(_hex(step["before"]), own, _hex(step["after"])).cast("binary"), 256))


def verified_documents(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Half of the ids (those whose crc32 is even) are checked against a text that lost its line
    feeds: ``folded_root`` folds that leaf along the original siblings. A null id is never
    tampered with. See ``merkle_manifest`` for ties, nulls and empty tables.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    manifest = merkle_manifest(docs, tampered, fanout=fanout)
    siblings = F.array_join(F.transform("way", lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), "")
    out = proofs(manifest).select(
        F.col("slot.id").alias("doc_id"), _hex(F.col("slot.digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        F.lit(manifest.root).cast("string").alias("root"), F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("slot.bent", "slot.digest"), F.col("way")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
