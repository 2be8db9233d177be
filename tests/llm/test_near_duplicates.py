from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from helpers import ODD, documents, words

from corpusloom.llm import components as K
from corpusloom.llm import simhash as S
from corpusloom.llm.common import Scratch


def fingerprint(text: str | None) -> int:
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n: int, linked) -> list[int]:
    r = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = r[a], r[b]
                r = [min(x, y) if v in (x, y) else v for v in r]
    return r


def near_copies(rng, n):
    base = words(rng, 60)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


def test_components_by_brute_force(spark):
    rng = random.Random(2)
    texts = ODD + near_copies(rng, 40) + near_copies(rng, 20) + [" ".join(words(rng, 30)) for _ in range(30)]
    prints = [fingerprint(t) for t in texts]
    want = roots(len(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(documents(spark, texts)).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in range(len(texts))}
    assert max(map(want.count, want)) > 2


def test_null_ids_and_empty_tables(spark):
    got = S.simhash_components(documents(spark, ["a b c d e", "a b c d e", "z"], [None, 4, None])).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == ["(4, 4)", "(None, 4)", "(None, None)"]
    assert S.simhash_components(documents(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_no_close_pair_misses_every_key(blocks):
    rng = random.Random(blocks)
    masks = S.block_masks(4, blocks)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), 4):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("tile", [3, 1024])
def test_tiles_lose_no_link(spark, tile):
    """One key holds everything, as in a group of thousands of near copies."""
    rng = random.Random(4)
    nodes = list({rng.getrandbits(8) << 3 for _ in range(40)})
    rows = [(0, 1, n, n.to_bytes(8, "big")) for n in nodes]
    found = K.links(spark.createDataFrame(rows, "kind int, key bigint, node bigint, print binary"), 1, Scratch(spark, "test"), tile)
    assert tile == 3 or found.count() < len(nodes)
    root = {r.node: r.root for r in K.components(found, Scratch(spark, "test")).collect()}
    want = roots(len(nodes), lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= 1)
    same = lambda f: {frozenset(n for n in nodes if f(n) == f(m)) for m in nodes}
    assert same(lambda n: root.get(n, n)) == same(lambda n: want[nodes.index(n)])


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a bigint, b bigint")
    assert {r.root for r in K.components(edges, Scratch(spark, "test")).collect()} == {0}
    assert K.components(edges.limit(0), Scratch(spark, "test")).count() == 0


def test_many_keys_of_a_large_group_leave_one_link_a_node(spark):
    """Groups of near copies whose smallest nodes differ from key to key, in tiles."""
    rows = [(kind, 1, n, (1 << n % 2).to_bytes(8, "big")) for kind in range(8) for n in range(40) if n % 8 != kind]
    found = K.links(spark.createDataFrame(rows, "kind int, key bigint, node bigint, print binary"), 2, Scratch(spark, "test"), 8)
    assert found.count() == 39
    assert {r.root for r in K.components(found, Scratch(spark, "test")).collect()} == {0}


def test_components_of_any_graph_by_brute_force(spark):
    rng = random.Random(9)
    order = rng.sample(range(100, 160), 60)
    pairs = [(rng.randrange(100), rng.randrange(100)) for _ in range(60)] + list(zip(order, order[1:], strict=False)) + [(199, i) for i in range(170, 190)] + [(169, 169)]
    pairs += [(b, a) for a, b in pairs[:20]] + pairs[:5]
    linked = {frozenset(p) for p in pairs}
    want = roots(200, lambda a, b: frozenset((a, b)) in linked)
    got = {r.node: r.root for r in K.components(spark.createDataFrame(pairs, "a bigint, b bigint"), Scratch(spark, "test")).collect()}
    assert got == {i: want[i] for a, b in pairs if a != b for i in (a, b)}


def test_near_dedup(spark):
    rng = random.Random(6)
    base = words(rng, 300, 5000)
    near = list(base)
    near[100] = near[200] = "changed"  # ten of 296 shingles
    half = base[:150] + words(rng, 150, 5000)
    fresh = [" ".join(words(rng, 80, 5000)) for _ in range(20)]
    texts = [" ".join(base), " ".join(near), " ".join(base).upper(), " ".join(half), *fresh, *ODD]
    df = documents(spark, texts)
    kept = S.near_dedup(df)
    ids = sorted(r.doc_id for r in kept.collect())
    odd = 4 + len(fresh)
    gone = {1, 2, odd + ODD.index("Same text here") + 1}
    assert ids == sorted(set(range(len(texts))) - gone)
    assert kept.columns == df.columns
    twice = S.near_dedup(documents(spark, ["a b c", "a b c", "q"], [3, 3, None])).collect()
    assert sorted(str(r.doc_id) for r in twice) == ["3", "None"]
    assert S.near_dedup(df.limit(0)).count() == 0


def test_spanning_links_of_wide_prints():
    x = np.random.default_rng(0).integers(0, 2**63, (5, 8), dtype=np.uint64)
    x[3] = x[1] ^ np.uint64(1)
    assert S.BLOCKS * S.BLOCK_SYMBOLS % 8 == 0 and K.spanning_links(x, 8) == [(1, 3)]


def grams(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a: str, b: str) -> float:
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def passage_pairs(rng, n, sizes):
    """Pairs of a text and its copy with a passage appended, inserted or cut, in turn."""
    out = []
    for i in range(n):
        base = words(rng, rng.randrange(60, 400), 50_000)
        size = int(len(base) * rng.uniform(*sizes))
        at = rng.randrange(len(base) - size)
        fresh = words(rng, size, 50_000)
        other = [base + fresh, base[:at] + fresh + base[at:], base[:at] + base[at + size :]][i % 3]
        out.append((" ".join(base), " ".join(other)))
    return out


def kept_pairs(spark, pairs):
    """How many documents of each pair stay."""
    texts = [t for pair in pairs for t in pair]
    ids = {r.doc_id for r in S.near_dedup(documents(spark, texts)).collect()}
    return [(2 * i in ids) + (2 * i + 1 in ids) for i in range(len(pairs))]


def test_near_dedup_finds_added_and_cut_passages(spark):
    pairs = passage_pairs(random.Random(12), 600, (0.05, 0.24))
    left = kept_pairs(spark, pairs)
    near = [n for n, (a, b) in zip(left, pairs, strict=True) if jaccard(a, b) >= 0.8]
    assert len(near) > 300 and set(near) == {1}


def revised_pairs(rng, n):
    """Pairs of a text and its copy with scattered words changed."""
    out = []
    for _ in range(n):
        base = words(rng, rng.randrange(100, 400), 50_000)
        other = list(base)
        for at in rng.sample(range(len(base)), max(1, round(len(base) * rng.uniform(0.01, 0.06)))):
            other[at] = "changed"
        out.append((" ".join(base), " ".join(other)))
    return out


def test_near_dedup_keeps_what_is_less_similar(spark):
    pairs = revised_pairs(random.Random(13), 600)
    left = kept_pairs(spark, pairs)
    similar = [jaccard(a, b) for a, b in pairs]
    assert sum(0.7 <= j < 0.8 for j in similar) > 80 and sum(j >= 0.8 for j in similar) > 80
    assert left == [1 if j >= 0.8 else 2 for j in similar]


@pytest.mark.parametrize("tile", [4, 512])
def test_links_within_a_cluster_by_brute_force(spark, tile):
    rng = random.Random(14)
    base = words(rng, 120, 50_000)
    texts = [" ".join(base[i * 4 : i * 4 + 80]) for i in range(10)] + [t for pair in revised_pairs(rng, 8) for t in pair]
    table = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "cluster bigint, node bigint, text string")
    root = {r.node: r.root for r in K.components(S.alike(table, 5, 0.8, Scratch(spark, "test"), tile), Scratch(spark, "test")).collect()}
    assert [root.get(i, i) for i in range(len(texts))] == roots(len(texts), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
