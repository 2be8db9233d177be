from __future__ import annotations

import hashlib
import random

import pytest
from helpers import ODD, documents, words

from corpusloom.llm import substring_dedup as S


def brute(texts, ids, window):
    seen: dict = {}
    for i, t in zip(ids, texts, strict=True):
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if i is not None:
                seen[g] = min(seen.get(g, i), i)
    out = []
    for i, t in zip(ids, texts, strict=True):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            first = seen.get(tuple(w[k : k + window]))
            if first is not None and (i is None or first < i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(str, out))


def corpus(rng):
    passage = words(rng, 90, 5000)
    other = words(rng, 60, 5000)
    texts = list(ODD)
    for k in range(60):
        a, b = words(rng, rng.randrange(0, 80), 5000), words(rng, rng.randrange(0, 80), 5000)
        middle = [passage, other, passage[:49], passage[20:75], [], other[5:58] + passage[10:70]][k % 6]
        texts.append(" ".join(a + middle + b))
    base = words(rng, 200, 5000)
    for _ in range(15):
        w = list(base)
        w[rng.randrange(200)] = "changed"
        texts.append(" ".join(w))
    texts += [texts[20], "ab " * 400, "ab " * 300, "ab cd " * 120]
    return texts


@pytest.mark.parametrize("hot, automaton", [(S.HOT, S.AUTOMATON), (3, 1000), (20_000, 2), (0, 1), (8, 1)])
def test_by_brute_force(spark, hot, automaton):
    texts = corpus(random.Random(9))
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    got = S.substring_digests(documents(spark, texts, ids), hot=hot, automaton=automaton).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute(texts, ids, 50)


def test_automaton_by_windows():
    rng = random.Random(3)
    parts = [[rng.randrange(4) for _ in range(rng.randrange(5, 30))] for _ in range(40)]
    a = S.Automaton()
    for k, p in enumerate(parts):
        a.add(p, k)
    seen: dict = {}
    for k, p in enumerate(parts):
        for i in range(len(p) - 4):
            seen.setdefault(tuple(p[i : i + 5]), k)
    for p in [*parts, [9, 0, 1, 2, 3, 0, 1, 9]]:
        assert a.first_keys(p, 5) == [seen.get(tuple(p[i : i + 5])) for i in range(len(p) - 4)]


@pytest.mark.parametrize("hot, automaton", [(20_000, 1000), (1, 1)])
def test_extreme_ids(spark, hot, automaton):
    rng = random.Random(17)
    passage = " ".join(words(rng, 80, 5000))
    texts = [passage, passage, "a " + passage, passage + " b", "c " + passage + " d", "e " + passage, passage]
    ids = [2**62 + 5, 2**62 + 6, 2**63 - 1, 2**63 - 2, -(2**63), None, None]
    got = S.substring_digests(documents(spark, texts, ids), hot=hot, automaton=automaton).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute(texts, ids, 50)
    two = S.substring_digests(documents(spark, [passage, passage], [2**62 + 5, 2**62 + 6])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in two) == [(2**62 + 5, 0), (2**62 + 6, 80)]


def test_words_whose_hashes_nearly_collide(spark):
    # the low 32 bits of the two words' hashes are equal
    assert S._Hashes()[b"id45158"] & 0xFFFFFFFF == S._Hashes()[b"id75823"] & 0xFFFFFFFF
    rng = random.Random(19)
    texts = []
    for _ in range(10):
        w = words(rng, 49, 5000)
        at = rng.randrange(50)
        texts += [" ".join([*w[:at], x, *w[at:]]) for x in ("id45158", "id75823")]
    assert all(r.n_removed == 0 for r in S.substring_digests(documents(spark, texts)).collect())


def test_one_id_of_many_texts(spark):
    rng = random.Random(23)
    passage = " ".join(words(rng, 60, 5000))
    texts = [f"{i} {passage} {i}" for i in range(30)] + [passage] * 5 + [None] * 5
    ids = [7] * 30 + [8] * 5 + [None] * 5
    got = S.substring_digests(documents(spark, texts, ids)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute(texts, ids, 50)


def test_ids_null_and_repeated(spark):
    rng = random.Random(11)
    passage = " ".join(words(rng, 70, 5000))
    texts = [passage, passage, passage + " x", passage, "y " + passage]
    ids = [None, None, 7, 7, 9]
    got = S.substring_digests(documents(spark, texts, ids)).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == brute(texts, ids, 50)
    alone = S.substring_digests(documents(spark, [passage, "z " + passage], [None, None])).collect()
    assert [r.n_removed for r in alone] == [0, 0]
    assert S.substring_digests(documents(spark, ["a"]).limit(0)).count() == 0


def test_filter_keeps_the_columns_and_what_is_left(spark):
    rng = random.Random(13)
    passage = " ".join(words(rng, 60, 5000))
    df = documents(spark, [f"start\n{passage}\nend", f" Before\n\n{passage}\n\nafter  it ", passage, None, "short"])
    rows = {r.doc_id: r for r in S.substring_filter(df).collect()}
    assert S.substring_filter(df).columns == df.columns
    assert set(rows) == {0, 1, 3, 4} and rows[0].text == f"start\n{passage}\nend" and rows[3].text is None
    assert rows[1].text == " Before\n\nafter  it " and rows[1].n_chars == len(rows[1].text) and rows[1].score == "mine"
    full = {r.doc_id: r.kept_text for r in S.substring_dedup(df).collect()}
    assert full[1] == "Before after it" and full[2] == ""
