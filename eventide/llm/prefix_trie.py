"""Trie of conversation prefixes by van Emde Boas recursion.

Depths 0 to 2^k - 1 are cut at half depth into an upper trie and the lower forests that hang
from the cut, and each of those again, all of one size at once:

* Names. Runs of 1, 2, 4, ... turns are named from the names of their halves. From the largest
  cut down, the prefix that ends at a cut is named by the prefix at the start of the part that is
  cut and the run from there to the cut. After k rounds every prefix has a name (128 bits of a
  SHA-256), in as many rows as there are turns.
* Totals. From the smallest parts up, the root of every lower tree passes its totals on to the
  nodes above it in the upper trie; its smallest member tells which these are. A depth is such a
  root once, in the round of its lowest binary digit. After k rounds the totals are whole.

No step takes a conversation or a node's members as one group: turns are numbered by ranges,
joins are by conversation and depth (or blocks of depths), sums have a map-side part, and the
few nodes with very many children are joined by a broadcast. Members that end at a node are
hashed as a stream of bounded pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm.common import numbered
from eventide.session import materialize, scratch_path

BLOCK = 4096  # depths of a conversation, or members of a node, that may meet in one group
SHARE = 1000  # a node with one in so many of all nodes as children is joined by a broadcast
WIDEST = 8  # the most turns taken over from another conversation


def _named(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Turns as conv, pos (from 0), size (turns of the conversation), name (128 bits), bytes (of the text).

    Ordered by turn, null first; turns that share a number by the digest of role and text. Null
    roles and texts are empty. Rows without a conversation's id belong to none and are left out.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), _named(whole.cast("binary")).alias("name"),
        F.octet_length(text).cast("long").alias("bytes"))
    return materialize(numbered(rows, ["conv"], ["turn", "name"], "turns").drop("turn"), "turns")


def rebuilt(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths (conv, depth from 1, name, bytes) and lengths (conv, length) of rebuilt conversations.

    Conversation c takes the first h turns of conversation c - c % 5, as far as there are any, and
    its own after its first h; h is the crc32 of c's digits modulo 9.
    """
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % (WIDEST + 1)
    convs = materialize(found.where("pos = 0").select("conv", F.col("size").alias("own"), taken.alias("h"),
                                                       (F.col("conv") - F.col("conv") % 5).alias("base")), "conversations")
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").select(
        "conv", "base", "own", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("lead"))
    heads = found.where(f"conv % 5 = 0 AND pos < {WIDEST}").select(F.col("conv").alias("base"), "pos", "name", "bytes")
    led = convs.join(heads, "base").where("pos < h").select("conv", (F.col("pos") + 1).alias("depth"), "name", "bytes")
    blocks = convs.select("conv", "h", "lead", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(own - 1) div {BLOCK}"))).alias("block"))
    rest = (found.withColumn("block", F.expr(f"pos div {BLOCK}")).join(blocks, ["conv", "block"]).where("pos >= h")
            .select("conv", (F.col("pos") - F.col("h") + F.col("lead") + 1).alias("depth"), "name", "bytes"))
    lengths = convs.select("conv", (F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return materialize(led.union(rest), "paths"), materialize(lengths, "lengths")


def plain(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths and lengths of conversations as they are."""
    return (found.select("conv", (F.col("pos") + 1).alias("depth"), "name", "bytes"),
            found.where("pos = 0").select("conv", F.col("size").alias("length")))


class Rounds:
    """A table that rounds add rows to: one folder, a part of it per round."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.path, self.schema, self.rounds = spark, scratch_path(spark, name), schema, 0

    def add(self, rows: DataFrame) -> None:
        rows.write.parquet(f"{self.path}/round={self.rounds}")
        self.rounds += 1

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop("round")


def prefixes(paths: DataFrame, lengths: DataFrame, rounds: int) -> DataFrame:
    """Every prefix of every conversation: conv, depth (0 for the empty one), node (its name), bytes of the last text."""
    runs = [paths.select("conv", (F.col("depth") - 1).alias("j"), "name", "bytes")]
    for _ in range(1, rounds):
        odd = F.col("j") % 2 == 1
        first, last = F.max(F.when(~odd, F.col("name"))), F.max(F.when(odd, F.col("name")))
        runs.append(materialize(
            runs[-1].groupBy("conv", F.expr("j div 2").alias("j"))
            .agg(first.alias("first"), last.alias("last"), F.max(F.when(odd, F.col("bytes"))).alias("bytes"))
            .where("first IS NOT NULL AND last IS NOT NULL").select("conv", "j", _named(F.col("first"), F.col("last")).alias("name"), "bytes"),
            "runs"))
    named = Rounds(paths.sparkSession, "prefixes", "conv long, depth long, node binary, bytes long")
    named.add(lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("node"), F.lit(0).cast("long").alias("bytes")))
    for r in range(rounds - 1, -1, -1):
        starts = named.rows().select("conv", F.col("depth").alias("start"), "node")
        cut = runs[r].where("j % 2 = 0").select("conv", (F.col("j") * (1 << r)).alias("start"), "name", "bytes")
        named.add(cut.join(starts, ["conv", "start"])
                  .select("conv", (F.col("start") + (1 << r)).alias("depth"), _named(F.col("node"), F.col("name")).alias("node"), "bytes"))
    return named.rows()


def totals(nodes: DataFrame, members: DataFrame, rounds: int) -> DataFrame:
    """depth, node, n_leaves and saved_tokens summed over each node's subtree.

    ``nodes`` has depth, node, conv (a member), leaf and saved of every node; ``members`` is the
    table of prefixes, which says what lies above a node on its member's path.
    """
    given = Rounds(nodes.sparkSession, "grafts", "depth long, node binary, n_leaves long, saved_tokens long")
    given.add(nodes.select("depth", "node", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens")))
    sums = [F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    for r in range(rounds):
        half, block = 1 << r, min(1 << r, BLOCK)
        lower = F.col("depth") % (2 * half) == half
        roots = given.rows().where(lower).groupBy("depth", "node").agg(*sums)
        above = (roots.join(nodes.where(lower).select("depth", "node", "conv"), ["depth", "node"])
                 .select("conv", "n_leaves", "saved_tokens", F.explode(F.sequence(
                     F.expr(f"(depth - {half}) div {block}"), F.expr(f"(depth - 1) div {block}"))).alias("block")))
        on_path = (members.where(F.col("depth") % (2 * half) < half)
                   .select("conv", F.expr(f"depth div {block}").alias("block"), "depth", "node"))
        given.add(on_path.join(above, ["conv", "block"]).groupBy("depth", "node").agg(*sums))
    return given.rows().groupBy("depth", "node").agg(*sums)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of equal (depth, node), comma-joined, as they come."""
    held, state = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": pa.array([held[0]], pa.int64()), "node": pa.array([held[1]], pa.binary()),
                                           "digest": [state.hexdigest()]})

    for batch in batches:
        for depth, node, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "piece")), strict=True):
            if held == (depth, node):
                state.update(b",")
            else:
                if held:
                    yield row()
                held, state = (depth, node), hashlib.sha256()
            state.update(piece.encode())
    if held:
        yield row()


def member_digests(ends: DataFrame) -> DataFrame:
    """SHA-256 (hex) of the ascending, comma-joined conv of each (depth, node)."""
    members = numbered(ends.select("depth", "node", "conv"), ["depth", "node"], ["conv"], "ends")
    listed = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = members.groupBy("depth", "node", F.expr(f"pos div {BLOCK}").alias("at")).agg(F.array_join(listed, ",").alias("piece"))
    keys = ["depth", "node"]
    return (pieces.repartition(*keys).sortWithinPartitions(*keys, "at").select(*keys, "piece")
            .mapInArrow(_digests, "depth long, node binary, digest string"))


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent_conv``, the smallest member of the node above.

    At most ``SHARE`` nodes can have one in ``SHARE`` of all nodes as children; those are
    broadcast, and their children stay where they are.
    """
    least = max(nodes.count() / SHARE, 1)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("above"), F.col("conv").alias("parent_conv"), "n_children")
    crowded = parents.where(F.col("n_children") >= least).drop("n_children").withColumn("settled", F.lit(True))
    tagged = nodes.join(F.broadcast(crowded), ["depth", "above"], "left")
    rest = tagged.where("settled IS NULL").drop("parent_conv", "settled").join(
        parents.where(F.col("n_children") < least).drop("n_children"), ["depth", "above"], "left")
    columns = [*nodes.columns, "parent_conv"]
    return tagged.where("settled").select(*columns).union(rest.select(*columns))


def prefix_trie(paths: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, node.

    A node is a distinct sequence of first turns and stands for the conversations that begin with
    it; the root for all, also those without turns. ``node`` is its name. No conversations, no rows.
    """
    longest = lengths.agg(F.max("length")).first()[0] or 0
    rounds = max(int(longest).bit_length(), 1)
    members = prefixes(paths, lengths, rounds)
    groups = members.groupBy("depth", "node").agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"))
    over = members.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("above"))
    nodes = materialize(groups.join(over, ["conv", "depth"], "left"), "nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(
        nodes.join(kids, ["depth", "node"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes"), "nodes")
    ends = materialize(member_digests(members.join(lengths.select("conv", F.col("length").alias("depth")), ["conv", "depth"])), "ends")
    summed = materialize(totals(nodes, members, rounds), "totals")
    keys = ["depth", "node"]
    return (materialize(with_parents(nodes), "parents").join(summed, keys).join(ends, keys, "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), F.lower(F.hex("node")).alias("node")))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (see ``rebuilt``, ``turns`` for ties and nulls), without names.

    Very long texts are read once, for their digest and size. Repeated rows are turns of their
    own. Other columns are ignored. An empty table gives no rows.
    """
    return prefix_trie(*rebuilt(turns(conversations))).drop("node")
