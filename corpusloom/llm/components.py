"""Links between nodes and their connected components, for the near-duplicate operators.

Links are searched within groups of nodes that share a key. Of each group only a spanning forest of
its links is emitted, at most one link a node: components are kept whole and no group's pairs are
ever written out. A group beyond a tile's size is dealt into tiles at random. Its links within tiles
come first, then those between one node of each component that they leave: this connects what is
alike throughout, such as a vast group of near copies, at a cost linear in the group. Then only nodes of different components are left
to be compared: those outside the group's largest component meet every tile, so no task ever holds
more than two tiles, and no link is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch

#: Nodes in a tile; a task compares two tiles at most.
TILE = 1024
#: Rows of the comparison that are in memory at once.
CHUNK = 128


def differing_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def differing_bytes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the eight bytes of each word differ."""
    z = x ^ y
    z |= z >> np.uint64(4)
    z |= z >> np.uint64(2)
    z |= z >> np.uint64(1)
    return np.bitwise_count(z & np.uint64(0x0101010101010101))


def spanning_links(prints: np.ndarray, most: int, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] = differing_bits) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most `most` differing bits, or as `apart` counts) between rows of (n, words) uint64."""
    n = len(prints)
    if n == 2:
        return [(0, 1)] if int(apart(prints[0], prints[1]).sum(dtype=np.int64)) <= most else []
    free = np.ones(n, bool)
    out = []
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        front = np.array([start])
        while len(front):
            part, front = front[:CHUNK], front[CHUNK:]
            rest = np.nonzero(free)[0]
            if not len(rest):
                break
            far = np.zeros((len(part), len(rest)), np.uint16)
            for k in range(prints.shape[1]):
                far += apart(prints[part, k][:, None], prints[rest, k][None, :])
            found = rest[(far <= most).any(axis=0)]
            free[found] = False
            out += [(start, int(x)) for x in found]
            front = np.concatenate([front, found])
    return out


def _in_groups(members: DataFrame, keys: list[str], find: Callable[[list], list[tuple[int, int]]]) -> DataFrame:
    """Links (a, b) within each group of (keys, node long, payload)."""
    groups = members.groupBy(*keys).agg(F.collect_list("node").alias("nodes"), F.collect_list("payload").alias("payloads")).where("size(nodes) > 1")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for nodes, payloads in zip(batch["nodes"], batch["payloads"], strict=True):
                # from the smallest node on: groups that share their nodes then give the same links
                nodes, first = np.unique(np.asarray(nodes, "int64"), return_index=True)
                for x, y in find([payloads[i] for i in first]):
                    a.append(nodes[x])
                    b.append(nodes[y])
            yield pd.DataFrame({"a": np.array(a, "int64"), "b": np.array(b, "int64")})

    return groups.select("nodes", "payloads").mapInPandas(run, "a long, b long").distinct()


def tiles_for(weight: Column) -> Column:
    """How many tiles a group of this weight has: a power of two, so groups of about one size have the same tiles."""
    return F.when(weight > 1, F.pow(F.lit(2.0), F.ceil(F.log2(weight)))).otherwise(1).cast("int")


def spanning_forest(members: DataFrame, keys: list[str], find: Callable[[list], list[tuple[int, int]]], scratch: Scratch, some_large: bool) -> DataFrame:
    """Links (a, b) that connect, within each group of `members`, all nodes that `find` connects.

    members: (keys, tiles int, node long, payload, weight double), a row for each node of a group;
    weight is its share of a tile, and tiles the group's number of them. find: a spanning forest of the
    links between payloads, by their places. some_large: whether any group has several tiles. A node's
    tile is the same in all groups of one size, and so are most of its links. Once components are
    known, one link from each of their nodes to the smallest stands for all links that made them.
    """
    edges = _in_groups(members.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))), [*keys, "tile"], find)
    if not some_large:
        return edges
    known = components(edges, scratch)

    def labelled() -> DataFrame:
        return members.where("tiles > 1").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))

    # a node of each component meets those of the others
    one = labelled().groupBy(*keys, "root").agg(F.min("node").alias("node"), F.min_by("payload", "node").alias("payload"), F.min_by("weight", "node").alias("weight"))
    one = scratch.keep(one)
    sizes = one.groupBy(*keys).agg(tiles_for(F.sum("weight")).alias("tiles"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = one.join(sizes, keys).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    known = components(stars(known).union(_in_groups(met, [*keys, "tile"], find)), scratch)
    large = labelled()
    parts = large.groupBy(*keys, "root").agg(F.sum("weight").alias("w"))
    split = parts.groupBy(*keys).agg(F.max(F.struct("w", "root")).alias("main"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    split = split.select(*keys, F.col("main.root").alias("main"), F.ceil("w").cast("int").alias("columns"), F.greatest(F.lit(1), F.ceil(F.col("w") - F.col("main.w"))).cast("int").alias("rows"))
    left = scratch.keep(large.select(*keys, "node", "payload", "root").join(split, keys))

    def tile_of(count: str) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(count)), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.expr(f"sequence(0, {count} - 1)"))

    whole = left.withColumn("column", tile_of("columns")).withColumn("row", every("rows"))
    rest = left.where("root <> main").withColumn("column", every("columns")).withColumn("row", tile_of("rows"))
    return stars(known).union(_in_groups(whole.unionByName(rest), [*keys, "column", "row"], find))


def links(keys: DataFrame, most: int, scratch: Scratch, tile: int = TILE, apart: Callable[[np.ndarray, np.ndarray], np.ndarray] = differing_bits) -> DataFrame:
    """Links (a, b) that connect the nodes that share a key and differ in at most `most` bits, or as `apart` counts.

    keys: (kind int, key long, node long, print binary), a row for each key of a node; nodes are
    distinct, and print is a whole number of 64-bit words.
    """

    def find(prints: list) -> list[tuple[int, int]]:
        return spanning_links(np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1), most, apart)

    sizes = scratch.keep(keys.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n > 1").select("kind", "key", tiles_for(F.col("n") / tile).alias("tiles")))
    members = keys.join(sizes, ["kind", "key"]).select("kind", "key", "tiles", "node", F.col("print").alias("payload"), F.lit(1 / tile).alias("weight"))
    return spanning_forest(members, ["kind", "key"], find, scratch, bool(sizes.where("tiles > 1").limit(1).count()))


def stars(labels: DataFrame) -> DataFrame:
    """Links (a, b) with the same components as the labels (node, root): one for each node but the roots."""
    return labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for each node of `edges` (a, b), root the smallest node that it reaches.

    At each level a node takes its smallest neighbour as its parent, parents' parents replace parents
    until they settle, and links between the nodes go over to links between their last parents, once
    each. Links within a tree are gone with that, so a level has few of those before: whatever number of
    links a group has by its keys, they are joined once, and later only what connects trees. A node that
    isn't alone with its tree meets a smaller one within two levels, so the levels are at most about
    twice the binary digits of the number of nodes, and the rounds in one those of its deepest tree.
    Labels only fall, so the smallest node is the last parent. What a level leaves is a written table: a
    lost executor costs no more than a step.
    """

    def once(pairs: DataFrame) -> tuple[DataFrame, str]:
        return scratch.put(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    left, left_path = once(edges)
    levels = []
    while not levels or left.limit(1).count():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels, path = scratch.put(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
        moved = 1
        while moved:
            second, third = (labels.select(F.col("node").alias(f"at{i}"), F.col("root").alias(f"root{i}")) for i in (2, 3))
            jumped = labels.join(second, F.col("root") == F.col("at2")).join(third, F.col("root2") == F.col("at3"))
            after, after_path = scratch.put(jumped.select("node", F.col("root3").alias("root"), (F.col("root3") < F.col("root2")).alias("moved")))
            moved = after.where("moved").limit(1).count()
            scratch.drop(path)
            labels, path = after.select("node", "root"), after_path
        levels.append((labels, path))
        x, y = (labels.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        rest, rest_path = once(left.join(x, "a").join(y, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        scratch.drop(left_path)
        left, left_path = rest, rest_path
    scratch.drop(left_path)
    labels, path = levels.pop()
    for below, below_path in reversed(levels):
        last = labels.select(F.col("node").alias("at"), F.col("root").alias("last"))
        whole, whole_path = scratch.put(below.join(last, F.col("root") == F.col("at"), "left").select("node", F.coalesce("last", "root").alias("root")))
        scratch.drop(path)
        scratch.drop(below_path)
        labels, path = whole, whole_path
    return labels
