"""Near-dedup: SimHash with pigeonhole blocks and the Hamming distance, and shingle similarity with smallest hashes.

A fingerprint is split into blocks; two that differ in at most d bits agree on at least (blocks - d)
of them, so each choice of that many blocks is a join key that no close pair misses. Equal
fingerprints are one node before any key is made, hot keys are tiled (see components.py).

`near_dedup` removes near copies at a similarity of 0.8 of five-word shingles. At that similarity two
SimHash fingerprints of 64 bits differ in ten bits, and blocks that ten differing bits can't all touch
are too narrow to select anything. Its fingerprint has 72 symbols instead, each the smallest of
another hash of the shingles, so a symbol differs with the probability 1 - similarity whatever the
kind of change. The same pigeonhole holds: 24 blocks of three symbols are the keys, and fingerprints
that differ in 23 symbols or fewer share a block for certain (a pair at 0.8 that differs in more still
does, but with a probability of 3e-8). Candidates are verified by the distance of the same symbols,
and make up clusters; within a cluster, links are pairs whose exact similarity reaches 0.8, and
nothing goes without such a link.

Defined results: a null or blank text has no shingles and the fingerprint zero (in `near_dedup` it
is kept, as no copy of anything); fewer words than a shingle make one shingle; repeated rows are
copies; a null id ranks after all others and is its group's component only if no row has an id; an
empty table gives an empty result; further columns are ignored, or kept by `near_dedup`.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, unused
from corpusloom.llm.components import components, differing_bytes, links, spanning_forest, tiles_for

#: Blocks of a fingerprint in `near_dedup`, and symbols in a block. All symbols together fill whole 64-bit words, a byte each.
BLOCKS, BLOCK_SYMBOLS = 24, 3
#: Documents and bytes of text in a tile of a cluster; two tiles at most are compared in a task.
CLUSTER_ROWS, CLUSTER_BYTES = 512, 8 << 20
#: Shingles whose bits are counted at once.
STEP = 16_384


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of `width` words joined by one space; of all words, if they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    runs = map(line.__getitem__, map(slice, starts, ends[width - 1 :].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(seed)), np.uint64, n)


def vote(hashes: np.ndarray) -> np.ndarray:
    """Fingerprint of (n, k) uint64 hashes as k words: a bit is 1 if it is set in over half of the rows."""
    n, k = hashes.shape
    count = np.zeros(64 * k, np.int64)
    for at in range(0, n, STEP):
        part = np.ascontiguousarray(hashes[at : at + STEP])
        count += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > n, bitorder="little").view(np.uint64)


def widen(hashes: np.ndarray, k: int) -> np.ndarray:
    """k independent 64-bit hashes of each hash, by a splitmix step."""
    with np.errstate(over="ignore"):
        x = hashes[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, k + 1, dtype=np.uint64)[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, print): the 64-bit fingerprint of each row of `docs` as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), np.uint64)
        for i, text in enumerate(texts):
            if isinstance(text, str):
                h = shingle_hashes(text.encode("utf-8", "replace").lower().split(), width, seed)
                if len(h):
                    out[i] = vote(h[:, None])[0]
        return pd.Series(out.view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run(F.col("text").cast("string")).alias("print"))


def block_masks(distance: int, blocks: int, bits: int = 64) -> list[int]:
    """The keys' masks: every choice of (blocks - distance) of the blocks.

    More blocks make more keys, of more bits each: a row more for every node, and fewer chance pairs.
    Either way no pair within the distance is missed.
    """
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def simhash_components(docs: DataFrame, width: int = 4, seed: int = 42, distance: int = 4, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of `docs` (doc_id, text).

    The number of blocks sets how many fingerprints a key has by chance, and no more: six give 15 keys of
    21 or 22 bits (24 fingerprints a key at 10^8), seven 35 keys of 27 (75 at 10^10), eight 70 keys of 32
    (23 at 10^11). Its results are the same whatever it is. See `components` for how rounds end.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    table = scratch.keep(fingerprints(docs, width, seed))
    nodes = scratch.keep(table.groupBy("print").agg(F.min("doc_id").alias("least")))
    masks = block_masks(distance, blocks)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col("print").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)]))
    keys = nodes.select(F.col("print").alias("node"), each.alias("k")).select("k.kind", "k.key", "node")
    # a long's bytes in either order compare alike
    keys = keys.withColumn("print", F.unhex(F.lpad(F.hex("node"), 16, "0")))
    roots = components(links(keys, distance, scratch), scratch)
    joined = nodes.join(roots, nodes["print"] == roots.node, "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = scratch.keep(joined.join(smallest, "root").select("print", "component_id"))
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return table.join(by_print, "print").select("doc_id", hexed, "component_id")


def smallest(hashes: np.ndarray, k: int) -> np.ndarray:
    """The least of each of k independent hashes, over all given ones."""
    return np.min([widen(hashes[at : at + STEP], k).min(axis=0) for at in range(0, len(hashes), STEP)], axis=0)


def signature(text: Column, width: int = 5) -> Column:
    """struct<text_id, print, blocks> of a text; null fields if it has no words.

    text_id is a 128-bit hash of the whole lower-cased word sequence, print the low byte of each
    symbol of the fingerprint, and blocks a hash of each block's whole symbols.
    """
    size = 8 * BLOCK_SYMBOLS

    @F.pandas_udf("struct<text_id:binary,print:binary,blocks:array<long>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        for text in texts:
            words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
            if not words:
                out.append((None, None, None))
                continue
            symbols = smallest(np.unique(shingle_hashes(words, width)), BLOCKS * BLOCK_SYMBOLS)
            raw = symbols.tobytes()
            blocks = [signed(xxhash.xxh3_64_intdigest(raw[at : at + size])) for at in range(0, len(raw), size)]
            out.append((xxhash.xxh3_128_digest(b" ".join(words)), symbols.astype(np.uint8).tobytes(), blocks))
        return pd.DataFrame(out, columns=["text_id", "print", "blocks"], dtype=object)

    return run(text)


def similar_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links (at least the given Jaccard similarity) between sets of distinct hashes."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, all_ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(all_ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(values), np.int64)
    free = np.arange(len(sets))
    out = []
    while len(free):
        start, free = int(free[0]), free[1:]
        front = [start]
        while front and len(free):
            x = front.pop()
            # sizes further apart than the similarity allows need no look
            fit = free[np.minimum(sizes[free], sizes[x]) >= similarity * np.maximum(sizes[free], sizes[x]) - 1e-9]
            if not len(fit):
                continue
            mark[ids[x]] = 1
            both = np.add.reduceat(mark[np.concatenate([ids[y] for y in fit])], np.cumsum(sizes[fit]) - sizes[fit])
            mark[ids[x]] = 0
            found = fit[both >= similarity * (sizes[fit] + sizes[x] - both) - 1e-9]
            out += [(x, int(y)) for y in found]
            front += found.tolist()
            free = free[~np.isin(free, found)]
    return out


def alike(members: DataFrame, width: int, similarity: float, scratch: Scratch, tile_rows: int = CLUSTER_ROWS) -> DataFrame:
    """Links (a, b) that connect the nodes of a cluster that are similar: exact, by their shingles.

    members: (cluster long, node long, text string), a row for each node.
    """

    def find(texts: list) -> list[tuple[int, int]]:
        return similar_links([np.unique(shingle_hashes(t.encode("utf-8", "replace").lower().split(), width)) for t in texts], similarity)

    weight = F.greatest(F.lit(1 / tile_rows), F.octet_length("text") / CLUSTER_BYTES)
    rows = members.select("cluster", "node", F.col("text").alias("payload"), weight.alias("weight"))
    sizes = rows.groupBy("cluster").agg(tiles_for(F.sum("weight")).alias("tiles")).where("tiles > 1")
    large = scratch.keep(sizes)  # few: the others need no look-up and stay in one tile
    dealt = rows.join(large, "cluster", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    return spanning_forest(dealt, ["cluster"], find, scratch, bool(large.limit(1).count()))


def near_dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, slack: float = 6.0) -> DataFrame:
    """`docs` with one document, the one of the smallest id, of each group of near copies.

    Documents link whose shingles have at least the given Jaccard similarity. Clusters are made of
    candidates whose fingerprints differ in no more symbols than expected at it, plus `slack` standard deviations.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    uid, mark = unused(docs, "_uid"), unused(docs, "_signature")
    rows = scratch.keep(docs.withColumn(uid, F.monotonically_increasing_id()).withColumn(mark, signature(F.col("text").cast("string"), width)))
    table = rows.where(F.col(f"{mark}.text_id").isNotNull()).select(F.col(uid).alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), f"{mark}.text_id", f"{mark}.print", f"{mark}.blocks")
    # equal texts are one node, named by its first row
    nodes = scratch.keep(table.groupBy("text_id").agg(F.min("uid").alias("node"), F.first("print").alias("print"), F.first("blocks").alias("blocks")))
    size = BLOCKS * BLOCK_SYMBOLS
    most = round(size * (1 - similarity) + slack * math.sqrt(size * similarity * (1 - similarity)))
    keys = nodes.select("node", "print", F.posexplode("blocks").alias("kind", "key"))
    clusters = components(links(keys, most, scratch, apart=differing_bytes), scratch).select("node", F.col("root").alias("cluster"))
    members = rows.join(clusters, rows[uid] == clusters["node"]).select("cluster", "node", F.col("text").cast("string").alias("text"))
    roots = components(alike(scratch.keep(members), width, similarity, scratch), scratch)
    named = nodes.select("text_id", "node").join(roots, "node", "left").select("text_id", F.coalesce("root", "node").alias("root"))
    grouped = table.select("uid", "doc_id", "text_id").join(named, "text_id")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    stays = grouped.groupBy("root").agg(F.min(rank).getField("uid").alias("uid"))
    goes = scratch.keep(grouped.select("uid").join(stays.select("uid"), "uid", "left_anti"))
    return rows.join(goes, rows[uid] == goes["uid"], "left_anti").drop(uid, mark)
