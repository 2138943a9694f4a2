"""Prefix trie of conversations, with totals of every subtree by centroid decomposition.

A node stands for one distinct sequence of first turns. Its name is the exclusive-or of 128-bit hashes of its turns and their
places, so the names of all prefixes are running totals, added up in pieces of ``PIECE`` turns, and no conversation is ever held
whole. (Two different prefixes share a name with a chance of about 2^-128.)

Totals over subtrees come from centroid decomposition of the parent links. A node's weight is the number of rebuilt turns at or
below it, which one grouped sum gives. The centroid of a component is its deepest node with more than half of the weight; the
component's values at or below it are added up once and given to every node from the centroid up to the component's top, then
the centroid goes: the subtrees of its children are components of their own, the rest is one with the weights along that path made
lighter. Every component has at most half of the weight, so there are logarithmic rounds however deep the trie is. Whether a
node is below the centroid is asked of its smallest member: that conversation's turn one deeper than the centroid must hang from
it. Components of more than ``BLOCK`` turns are split by joins over all tasks; smaller ones are finished inside one task, many
components at a time, in the same way.

Defined results: turns are in order of ``turn`` (NULL first), then role, then text; a NULL role or text is empty; rows without
``conv_id`` belong to no conversation and are left out; repeated rows are repeated turns; an empty table has no nodes; only the
named columns are read and returned, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparcel.session import ship, written

PIECE, BLOCK = 512, 1 << 13
#: Rows of whole components that a task works on at a time.
ROWS = 1 << 14
#: SQL of the root's name.
ROOT = "named_struct('a', 0L, 'b', 0L)"
NOTHING = hashlib.sha256().hexdigest()


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, place, key, size, turns)``: each turn's place from 1, digest and code points, and its conversation's turns.

    A range exchange over conversation and turn sorts all rows, so that a long conversation lies in many tasks; the texts are
    read no further. The counts of a conversation's tasks, one row for each, give the places.
    """
    c, r, t = F.col(conv_id), F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.where(c.isNotNull()).select(c.cast("bigint").alias("conv"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    by = ("conv", "turn", "role", "text")
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), 1, 32))
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).select(
        "conv", digest.alias("key"), F.length("text").cast("bigint").alias("size"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row")
    )
    placed = written(placed, "turns")
    counts = placed.groupBy("conv", "task").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    whole = Window.partitionBy("conv")
    before = whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("conv", "task", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"), F.sum("n").over(whole).alias("turns"))
    return placed.join(shifts, ["conv", "task"]).select("conv", (F.col("row") + F.col("shift")).alias("place"), "key", "size", "turns")


def paths(turns: DataFrame) -> DataFrame:
    """``(conv, depth, len, size, node, parent)`` for each turn of ``(conv, depth, len, key, size)``, ``depth`` from 1 to ``len``."""
    piece = F.floor((F.col("depth") - 1) / PIECE).cast("int")
    rows = turns.withColumn("piece", piece)
    for k in ("a", "b"):
        rows = rows.withColumn(f"own_{k}", F.xxhash64(F.lit(k), F.col("depth").cast("bigint"), "key"))
    rows = written(rows.drop("key"), "rebuilt")
    running = Window.partitionBy("conv", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("conv", "piece").agg(F.bit_xor("own_a").alias("a"), F.bit_xor("own_b").alias("b"))
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "piece", *[F.bit_xor(k).over(before).alias(f"before_{k}") for k in ("a", "b")]).where("piece > 0")
    rows = rows.select("*", *[F.bit_xor(f"own_{k}").over(running).alias(k) for k in ("a", "b")]).join(totals, ["conv", "piece"], "left")
    for k in ("a", "b"):
        rows = rows.withColumn(k, F.col(k).bitwiseXOR(F.coalesce(f"before_{k}", F.lit(0).cast("bigint"))))
    parent = F.struct(*[F.col(k).bitwiseXOR(F.col(f"own_{k}")).alias(k) for k in ("a", "b")])
    return rows.select("conv", F.col("depth").cast("bigint").alias("depth"), F.col("len").cast("bigint").alias("len"), "size", F.struct("a", "b").alias("node"), parent.alias("parent"))


def trie_nodes(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of ``paths`` and the root of the conversations in ``lengths (conv, len)``, with what one grouped sum tells of each.

    ``conv`` is the smallest member, ``weight`` the rebuilt turns at or below the node, ``leaves`` 1 for a childless node.
    """
    last, n = F.col("len") - F.col("depth") + 1, F.count("*").alias("n_convs")
    nodes = steps.groupBy("node").agg(
        F.min("parent").alias("parent"), F.min("conv").alias("conv"), F.min("depth").alias("depth"), n, F.sum(last).alias("weight"), F.min("size").alias("size")
    )
    root = lengths.agg(F.min("conv").alias("conv"), n, F.sum(F.col("len").cast("bigint") + 1).alias("weight")).where("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.select(F.expr(ROOT).alias("node"), F.lit(None).cast("struct<a: bigint, b: bigint>").alias("parent"), "conv", zero.alias("depth"), "n_convs", "weight", zero.alias("size"))
    return nodes.unionByName(root).select(
        "node", "parent", "conv", "depth", "n_convs", "weight", (F.col("weight") == F.col("n_convs")).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )


def decompose(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Totals of ``values`` (columns) over the subtrees of a forest whose parents (-1: none) stand before their children."""
    n = len(parent)
    parent, weight, total = parent.copy(), weight.copy(), np.zeros_like(values)
    top = np.where(parent < 0, np.arange(n), parent)
    while (top[top] != top).any():
        top = top[top]
    left = np.arange(n)
    centre, below = np.zeros(n, np.int64), np.zeros_like(values)
    while len(left):
        heavy = left[2 * weight[left] > weight[top[left]]]
        centre[top[heavy]] = heavy  # of a component's heavy path the deepest, which stands last
        x = centre[top[left]]
        jump = np.arange(n)
        go = (left != x) & (parent[left] != x) & (parent[left] >= 0)
        jump[left[go]] = parent[left[go]]
        while (jump[jump[left]] != jump[left]).any():
            jump[left] = jump[jump[left]]
        to = jump[left]
        under = (left == x) | (parent[to] == x)
        below[x] = 0
        np.add.at(below, x[under], values[left[under]])
        at = centres = np.unique(x)
        while len(at):  # along every path from a centroid to the top of its component
            total[at] += below[centres]
            on = parent[at] >= 0
            weights = weight[centres]
            at, centres = parent[at[on]], centres[on]
            weight[at] -= weights[on]
        child = under & (left != x)
        top[left[child]] = to[child]
        parent[to[child]] = -1
        left = left[left != x]
    return total


def _finish(parts: DataFrame) -> DataFrame:
    """``(node, leaves, saved)``: the totals inside components that a task can hold."""
    ship(parts.sparkSession)
    rows = parts.select("top.a", "top.b", "depth", F.col("node.a").alias("na"), F.col("node.b").alias("nb"), F.col("parent.a").alias("pa"), F.col("parent.b").alias("pb"), "weight", "leaves", "saved")
    rows = rows.repartition("a", "b").sortWithinPartitions("a", "b", "depth")

    def totals(table: pa.Table) -> pa.RecordBatch:
        a, b, na, nb, pa_, pb, *numbers = (table.column(k).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for k in ("a", "b", "na", "nb", "pa", "pb", "weight", "leaves", "saved"))
        names = {k: i for i, k in enumerate(zip(na.tolist(), nb.tolist()))}
        parent = np.array([names.get(k, -1) for k in zip(pa_.tolist(), pb.tolist())], np.int64)
        parent[(na == a) & (nb == b)] = -1
        sums = decompose(parent, numbers[0], np.stack(numbers[1:], axis=1))
        columns = (na, nb, np.ascontiguousarray(sums[:, 0]), np.ascontiguousarray(sums[:, 1]))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "leaves", "saved"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if len(held) < ROWS:
                continue
            a, b = (held.column(k).combine_chunks().to_numpy() for k in ("a", "b"))
            cut = int(np.argmax((a == a[-1]) & (b == b[-1])))  # the last component may go on in the next batch
            if cut:
                yield totals(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield totals(held)

    done = rows.mapInArrow(run, "a bigint, b bigint, leaves bigint, saved bigint")
    return done.select(F.struct("a", "b").alias("node"), "leaves", "saved")


def rollup(nodes: DataFrame, steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(node, leaves, saved)``: the totals of ``leaves`` and ``saved`` over each node's subtree."""
    rest = nodes.select("node", "parent", "conv", "depth", "weight", "leaves", "saved", F.expr(ROOT).alias("top"))
    given, small = [], []
    while True:
        large = rest.groupBy("top").agg(F.max("weight").alias("whole"), F.min("depth").alias("from")).where(F.col("whole") > block)
        large = written(large, "large")  # fewer than the number of turns / block
        if large.isEmpty():
            small.append(rest)
            break
        small.append(rest.join(large, "top", "left_anti"))
        rest = rest.join(large, "top")
        centre = F.max_by(F.struct(F.col("node").alias("x"), F.col("conv").alias("x_conv"), F.col("depth").alias("x_depth"), F.col("weight").alias("x_weight")), "depth")
        centres = rest.where(2 * F.col("weight") > F.col("whole")).groupBy("top", "from").agg(centre.alias("c")).select("top", "from", "c.*")
        centres = written(centres, "centres")
        deeper = steps.join(centres.select((F.col("x_depth") + 1).alias("depth")).distinct(), "depth", "left_semi")
        deeper = deeper.select(F.col("conv").alias("x_of"), F.col("depth").alias("x_next"), F.col("node").alias("child"), F.col("parent").alias("above"))
        rest = rest.drop("whole", "from").join(centres, "top")
        rest = rest.join(deeper, F.expr("depth > x_depth AND conv = x_of AND x_depth + 1 = x_next"), "left")
        rest = rest.withColumn("child", F.when(F.col("above") == F.col("x"), F.col("child"))).drop("x_of", "x_next", "above")
        rest = written(rest, "split")
        under = rest.where(F.col("child").isNotNull() | (F.col("node") == F.col("x"))).groupBy("top").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        spine = steps.select("node", "conv", "depth").join(centres.withColumnRenamed("x_conv", "conv"), "conv").where("depth BETWEEN `from` AND x_depth")
        crown = centres.where("`from` = 0").select(F.col("x_conv").alias("conv"), F.expr(ROOT).alias("node"), F.col("from").alias("depth"), *[c for c in centres.columns if c != "x_conv"])
        spine = spine.unionByName(crown)
        spine = spine.join(under, "top").select("node", "leaves", "saved", F.when(F.col("depth") < F.col("x_depth"), F.col("x_weight")).alias("less"))
        spine = written(spine, "spine")
        given.append(spine.select("node", "leaves", "saved"))
        rest = rest.where(F.col("node") != F.col("x")).join(spine.where("less IS NOT NULL").select("node", "less"), "node", "left")
        rest = rest.select(
            "node", "parent", "conv", "depth", (F.col("weight") - F.coalesce("less", F.lit(0))).alias("weight"), "leaves", "saved", F.coalesce("child", "top").alias("top")
        )
        rest = written(rest, "rest")
    for part in small:
        given.append(_finish(part))
    sums = given[0]
    for more in given[1:]:
        sums = sums.unionByName(more)
    return sums.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def digests(ends: DataFrame) -> DataFrame:
    """``(node, sha)``: SHA-256 of the comma-joined ids of ``(node, conv)``, ascending. The ids of a node run through one hash."""
    ship(ends.sparkSession)
    rows = ends.select("node.a", "node.b", "conv").repartition("a", "b").sortWithinPartitions("a", "b", "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != node:
                    if node is not None:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (a, b), hashlib.sha256(str(conv).encode())
                else:
                    sha.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), (pa.int64(), pa.int64(), pa.string()))] if done else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string())], names=["a", "b", "sha"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([sha.hexdigest()])], names=["a", "b", "sha"])

    return rows.mapInArrow(run, "a bigint, b bigint, sha string").select(F.struct("a", "b").alias("node"), "sha")


def prefix_trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each node of the trie of ``turns (conv, depth, len, key, size)``; ``lengths (conv, len)`` has every conversation.

    ``conv_id`` is the smallest member, ``saved_tokens`` adds up, over the node's subtree, each node's members but one times the
    code points of its last text, ``ends_sha256`` is the digest of the ids of the conversations that end in the node.
    """
    lengths = written(lengths, "lengths")
    steps = written(paths(turns), "steps")
    nodes = written(trie_nodes(steps, lengths), "nodes")
    sums = rollup(nodes, steps, block)
    ends = steps.where("depth = len").select("node", "conv").unionByName(lengths.where("len = 0").select(F.expr(ROOT).alias("node"), "conv"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")
    facts = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    facts = facts.select("node", "children", zero.alias("leaves"), zero.alias("saved"), none.alias("sha"))
    facts = facts.unionByName(sums.select("node", zero.alias("children"), "leaves", "saved", none.alias("sha")))
    facts = facts.unionByName(digests(ends).select("node", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "sha"))
    facts = facts.groupBy("node").agg(*[F.sum(k).alias(k) for k in ("children", "leaves", "saved")], F.max("sha").alias("sha"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    return nodes.drop("leaves", "saved", "weight").join(facts, "node").join(above, "parent", "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"),
    )


def grafted(turns: DataFrame, head: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of their family's first, as ``(turns, lengths)`` for ``prefix_trie``.

    Conversation ``c`` gets the first ``h`` turns of ``c - c % family``, then its own after its first ``h``, where
    ``h = crc32(c) % head``. Only the ``head - 1`` first turns of a family's first conversation are copied.
    """
    turns = written(turns, "numbered")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % head).alias("h")
    convs = turns.select("conv", "turns").where("place = 1").select("conv", "turns", h, (F.col("conv") - F.col("conv") % family).alias("base"))
    base = convs.select(F.col("conv").alias("base"), F.col("turns").alias("base_turns"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_turns", F.lit(0))))
    convs = convs.withColumn("len", F.col("taken") + F.greatest(F.col("turns") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv", "base", "h", "taken", "len"), "convs")
    own = turns.join(convs, "conv").where("place > h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "len", "key", "size")
    heads = turns.where(F.col("place") < head).select(F.col("conv").alias("base"), "place", "key", "size")
    heads = heads.join(convs, "base").where("place <= h").select("conv", F.col("place").alias("depth"), "len", "key", "size")
    return own.unionByName(heads), convs.select("conv", "len")
