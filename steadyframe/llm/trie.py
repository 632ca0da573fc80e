"""Prefix tries of conversations: succinct level-order tries of prefix shards, heavy upper levels merged apart."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyframe.llm.common import materialize, release, sorted_groups, spread_join, trim

#: A node with more turns below it, counted for each member, is heavy; the tree under a lighter one fits in a shard.
HEAVY = 200_000
#: Turns of a conversation whose prefixes are made in one window; longer ones go in several.
STRETCH = 4_096
PACKED = "bits binary, nodes int, labels binary, counts binary, chars binary, depths binary, keys binary, above binary"
KEY = ["x1", "x2"]


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to a written table (conv_id, i, t1, t2, chars): the place among the conversation's turns, from 1, by turn
    (null first), then role and text; two hashes of role and text; code points. A long conversation is cut over tasks by ranges."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where("conv_id is not null").repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select("conv_id", F.monotonically_increasing_id().alias("seq"), F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"), F.length("text").cast("long").alias("chars"))
    rows = materialize(rows, "turns").withColumn("part", F.shiftright("seq", 33))
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", before).where("before is not null").select("conv_id", "part", "before")  # one a boundary between tasks at most
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy("seq"))
    rows = spread_join(rows.withColumn("i", place), parts, ["conv_id", "part"], "left")
    return rows.select("conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("i"), "t1", "t2", "chars")


def rebuilt(turns: DataFrame, base: Column, shared: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): each conversation is the first ``shared`` turns (``most`` at most) of the conversation ``base``, then its own after as many.

    Conversations: (conv_id, length). Rows: (conv_id, d, length, t1, t2, chars), d from 1."""
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", base.alias("base"), shared.cast("long").alias("h"))
    first = turns.where((base == F.col("conv_id")) & (F.col("i") <= most)).withColumnRenamed("conv_id", "base")
    given = first.groupBy("base").agg(F.count("*").alias("given"))
    convs = own.join(given, "base", "left").withColumn("m", F.least("h", F.coalesce("given", F.lit(0))))
    convs = materialize(convs.select("conv_id", "base", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    upper = convs.select("conv_id", "base", "m", "length").join(first, "base").where("i <= m").select("conv_id", F.col("i").alias("d"), "length", "t1", "t2", "chars")
    lower = turns.join(convs, "conv_id").where("i > h").select("conv_id", (F.col("m") + F.col("i") - F.col("h")).alias("d"), "length", "t1", "t2", "chars")
    return convs.select("conv_id", "length"), upper.unionByName(lower)


def prefixes(rows: DataFrame) -> DataFrame:
    """A written table (conv_id, d, length, x1, x2, p1, p2, chars): the keys of each prefix and of its parent; 0, 0 is the root.

    A prefix's key is the exclusive or of 128 bits for each (place, turn), so it needs no order and a long conversation goes in stretches.
    """
    keys = [F.xxhash64(F.lit(3 + k), "d", f"t{k}").alias(f"z{k}") for k in (1, 2)]
    rows = materialize(rows.select("conv_id", "d", "length", *keys, "chars", F.shiftright("d", STRETCH.bit_length() - 1).alias("stretch")), "paths")
    totals = rows.where(F.col("length") >= STRETCH).groupBy("conv_id", "stretch").agg(F.expr("bit_xor(z1)").alias("y1"), F.expr("bit_xor(z2)").alias("y2"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv_id", "stretch", *[F.expr(f"bit_xor(y{k})").over(before).alias(f"y{k}") for k in (1, 2)]).where("y1 is not null")
    inside = Window.partitionBy("conv_id", "stretch").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.expr(f"bit_xor(z{k})").over(inside).alias(f"x{k}") for k in (1, 2)])
    rows = spread_join(rows, totals, ["conv_id", "stretch"], "left")
    for k in (1, 2):
        rows = rows.withColumn(f"x{k}", F.col(f"x{k}").bitwiseXOR(F.coalesce(f"y{k}", F.lit(0)))).withColumn(f"p{k}", F.col(f"x{k}").bitwiseXOR(F.col(f"z{k}")))
    return materialize(rows.select("conv_id", "d", "length", "x1", "x2", "p1", "p2", "chars"), "prefixes")


# --- level-order tries in numpy


def places(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where the keys ``y`` (two columns) are among the distinct keys ``x``, or -1."""
    order = np.lexsort((x[:, 1], x[:, 0]))
    a, b = x[order, 0], x[order, 1]
    at = np.searchsorted(a, y[:, 0])
    while len(a):
        here = np.minimum(at, len(a) - 1)
        next_ = (at < len(a)) & (a[here] == y[:, 0]) & (b[here] < y[:, 1])
        if not next_.any():
            return np.where((at < len(a)) & (a[here] == y[:, 0]) & (b[here] == y[:, 1]), order[here], -1)
        at = at + next_
    return np.full(len(y), -1)


def level_order(keys: np.ndarray, above: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, degrees): the nodes of a forest level by level, siblings by label, and the children of the node above all trees and of each node."""
    up = places(keys, above)
    order, rank, depth = np.zeros(0, dtype=np.int64), np.full(len(keys), -1), np.full(len(keys), -1)
    level = np.flatnonzero(up < 0)
    children = np.argsort(up, kind="stable")
    starts = np.searchsorted(up[children], np.arange(len(keys) + 1))
    while len(level):
        parents = np.where(up[level] < 0, -1, rank[up[level]])
        level = level[np.lexsort((labels[level], parents))]
        rank[level] = len(order) + np.arange(len(level))
        order = np.concatenate([order, level])
        sizes = starts[level + 1] - starts[level]
        at = np.repeat(starts[level] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
        level = children[at]
    return order, np.bincount(np.where(up < 0, 0, rank[up] + 1), minlength=len(keys) + 1)


def bitvector(degrees: np.ndarray) -> np.ndarray:
    """A one for each child, then a zero, for each node in level order."""
    bits = np.ones(int(degrees.sum()) + len(degrees), dtype=np.uint8)
    bits[np.cumsum(degrees) + np.arange(len(degrees))] = 0
    return bits


class Louds:
    """A level-order trie read from its bits; node 0 is above all trees."""

    def __init__(self, bits: np.ndarray) -> None:
        ends = np.flatnonzero(bits == 0)
        self.degrees = np.diff(np.concatenate(([-1], ends))) - 1
        ones = np.flatnonzero(bits)
        self.parents = np.concatenate(([-1], ones - np.arange(len(ones))))  # the zeros before a node's one

    def levels(self) -> list[tuple[int, int]]:
        out, at = [], (0, 1)
        while at[0] < at[1]:
            out.append(at)
            at = at[1], at[1] + int(self.degrees[at[0] : at[1]].sum())
        return out

    def rolled_up(self, own: np.ndarray) -> np.ndarray:
        """Sums of ``own`` over each node's subtree, levels in reverse."""
        total = own.copy()
        for a, b in reversed(self.levels()[1:]):
            np.add.at(total, self.parents[a:b], total[a:b])
        return total


def shards(nodes: DataFrame) -> DataFrame:
    """Nodes (r1, r2, conv_id, d, n_convs, chars, x1, x2, p1, p2) to written tries, each of whole trees; r1, r2 is the key of a node's tree."""

    def run(frames):
        for f in sorted_groups(frames, ["r1", "r2"]):
            keys, above = f[["x1", "x2"]].to_numpy(), f[["p1", "p2"]].to_numpy()
            order, degrees = level_order(keys, above, f["conv_id"].to_numpy())
            row = [np.packbits(bitvector(degrees)).tobytes(), len(f)]
            row += [f[c].to_numpy()[order].astype("<i8").tobytes() for c in ("conv_id", "n_convs", "chars", "d")]
            row += [np.ascontiguousarray(x[order].astype("<i8")).tobytes() for x in (keys, above)]
            yield type(f)([row], columns=[c.split()[0] for c in PACKED.split(", ")])
        trim()

    return materialize(nodes.repartition("r1", "r2").sortWithinPartitions("r1", "r2").mapInPandas(run, PACKED), "tries")


def rollups(tries: DataFrame) -> DataFrame:
    """Tries to rows (x1, x2, p1, p2, top, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens); the parents of tops are not known yet."""
    kinds = [("x1", "long"), ("x2", "long"), ("p1", "long"), ("p2", "long"), ("top", "boolean")]
    kinds += [(c, "long") for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(c)[r].as_py() for c, n in enumerate(batch.schema.names)}
                n = row["nodes"]
                trie = Louds(np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: 2 * n + 1])
                labels, counts, chars, depths = (np.frombuffer(row[c], "<i8") for c in ("labels", "counts", "chars", "depths"))
                keys, above = (np.frombuffer(row[c], "<i8").reshape(-1, 2) for c in ("keys", "above"))
                leaves = trie.rolled_up(np.concatenate(([0], (trie.degrees[1:] == 0).astype(np.int64))))[1:]
                saved = trie.rolled_up(np.concatenate(([0], (counts - 1) * chars)))[1:]
                top = trie.parents[1:] == 0
                parent = pa.array(labels[np.where(top, 0, trie.parents[1:] - 1)], mask=top)
                values = [keys[:, 0], keys[:, 1], above[:, 0], above[:, 1], top, depths, labels, parent, counts, trie.degrees[1:], leaves, saved]
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(np.ascontiguousarray(v)) for v in values], names=[k for k, _ in kinds])
        trim()

    return tries.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds))


# --- heavy nodes


def sums_below(nodes: DataFrame) -> DataFrame:
    """(x1, x2, a1, a2, leaves, saved) with the parent's key a1, a2 (null at the root) to (x1, x2, leaves, saved) summed over subtrees.

    In round k a node has the sums of what is less than 2^k below it and its ancestor 2^k above, so a tree of depth n takes log2(n) rounds.
    """
    now = materialize(nodes, "below")
    while not now.where("a1 is not null").isEmpty():
        sums = now.where("a1 is not null").groupBy(F.col("a1").alias("x1"), F.col("a2").alias("x2")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("extra"))
        higher = now.select(F.col("x1").alias("a1"), F.col("x2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        both = spread_join(now, higher, ["a1", "a2"], "left").join(sums, KEY, "left")
        rest = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("leaves", "more"), ("saved", "extra"))]
        before, now = now, materialize(both.select("x1", "x2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), *rest), "below")
        release(before)
    return now.select("x1", "x2", "leaves", "saved")


def digests(ends: DataFrame) -> DataFrame:
    """(x1, x2, conv_id) to (x1, x2, ends_sha256) of each key's ids in order. Ranges of ids become texts in many tasks; only these, a few bytes an id,
    go by one task a key, as the digest wants them in sequence; none is held."""

    def joined(frames):
        for f in frames:
            x1, x2, ids = (f[c].to_numpy() for c in ("x1", "x2", "conv_id"))
            new = np.ones(len(f), dtype=bool)
            new[1:] = (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])
            cuts = np.append(np.flatnonzero(new), len(f)).tolist()
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, cuts[1:])]
            yield type(f)({"x1": x1[new], "x2": x2[new], "first": ids[new], "ids": texts})

    def hashed(frames):
        at, state = None, None
        for f in frames:
            out = []
            for a, b, ids in zip(f["x1"].tolist(), f["x2"].tolist(), f["ids"]):
                if at == (a, b):
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, state.hexdigest()))
                at, state = (a, b), hashlib.sha256(ids.encode())
            yield type(f)(out, columns=["x1", "x2", "ends_sha256"])
        if at is not None:
            yield type(f)([(*at, state.hexdigest())], columns=["x1", "x2", "ends_sha256"])

    parts = ends.repartitionByRange("x1", "x2", "conv_id").sortWithinPartitions("x1", "x2", "conv_id").mapInPandas(joined, "x1 long, x2 long, first long, ids string")
    return parts.repartition("x1", "x2").sortWithinPartitions("x1", "x2", "first").mapInPandas(hashed, "x1 long, x2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, base: Column, shared: Column, most: int, heavy: int = HEAVY) -> DataFrame:
    """The trie of rebuilt conversations, a row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role and text (other columns are ignored); a conversation starts with the first ``shared`` turns, ``most`` at most, of
    the conversation ``base``, both expressions over conv_id, and goes on with its own. Rows without a conv_id belong to no conversation; null
    roles and texts are empty; turns with one number are ordered by role and text, and repeated rows are turns each. Very long
    texts count by their code points and are hashed once; very long conversations are cut over tasks. No conversations give no rows, not even the root.

    A node with more than ``heavy`` turns of members below it is heavy, and so is the root. Each tree below the heavy nodes is a part of a
    shard's trie; the heavy nodes, at most turns * depth / ``heavy``, get the sums of their light trees and then of each other.
    """
    convs, rows = rebuilt(ordered_turns(turns), base, shared, most)
    paths = prefixes(rows)
    weights = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("d")).alias("below")]
    nodes = materialize(paths.groupBy("d", "x1", "x2", "p1", "p2", "chars").agg(*weights), "nodes")
    is_heavy = F.col("below") + F.col("n_convs") > heavy
    high = nodes.where(is_heavy)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("length").alias("below")).where("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(F.lit(0).cast("long").alias("d"), *[F.lit(0).cast("long").alias(c) for c in KEY], none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("chars"), "conv_id", "n_convs", "below")
    top = materialize(high.unionByName(root), "heavy")

    # the tree of a light node is that of its smallest member: the prefix one longer than the member's longest heavy one
    deepest = spread_join(paths.select("conv_id", "d", *KEY), high.select(*KEY), KEY, "inner").groupBy("conv_id").agg(F.max("d").alias("deepest"))
    trees = spread_join(paths.select("conv_id", "d", *KEY), deepest, ["conv_id"], "left").where(F.col("d") == F.coalesce("deepest", F.lit(0)) + 1)
    trees = trees.select("conv_id", F.col("x1").alias("r1"), F.col("x2").alias("r2"))
    light = rollups(shards(nodes.where(~is_heavy).join(trees, "conv_id").select("r1", "r2", "conv_id", "d", "n_convs", "chars", "x1", "x2", "p1", "p2")))
    light = materialize(light, "light")

    parents = top.select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("above_id"))
    grown = light.where("top").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("trees"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    branches = top.where("d > 0").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("branches"))
    own = top.join(grown, KEY, "left").join(branches, KEY, "left").na.fill(0, ["trees", "leaves", "saved", "branches"])
    own = materialize(own.withColumn("leaf", (F.col("below") == 0).cast("long")), "own")
    sums = sums_below(own.select(*KEY, F.col("p1").alias("a1"), F.col("p2").alias("a2"), (F.col("leaves") + F.col("leaf")).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved")))
    upper = spread_join(own.drop("leaves", "saved").join(sums, KEY), parents, ["p1", "p2"], "left")
    upper = upper.select(*KEY, F.col("d").alias("depth"), "conv_id", F.col("above_id").alias("parent_conv_id"), "n_convs", (F.col("trees") + F.col("branches")).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    tops = spread_join(light.where("top").drop("parent_conv_id"), parents, ["p1", "p2"], "left").withColumnRenamed("above_id", "parent_conv_id")
    found = upper.unionByName(light.where("not top").select(upper.columns)).unionByName(tops.select(upper.columns))

    ends = paths.where("d = length").select(*KEY, "conv_id").unionByName(convs.where("length = 0").select(F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"), "conv_id"))
    found = found.join(digests(ends), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
