from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, documents, words
from tokenizers import Tokenizer

from corpusloom.llm.packing import encode, first_fit, is_plain, pack_documents
from corpusloom.llm.quality_rules import quality_rules

SPACE = "[ \t-\r]+"
PATH = public_tokenizers.path("word_bpe_49k.json")


def texts_of(rng):
    out = list(ODD)
    for _ in range(30):
        line = " ".join(words(rng, rng.randrange(1, 40), 30))
        out.append("\n".join(rng.choice([line, " ".join(words(rng, 12, 30)), "", "- x", "### a|b"]) for _ in range(rng.randrange(1, 8))))
    return out


def test_measures_by_brute_force(spark):
    texts = texts_of(random.Random(1))
    got = {r.doc_id: r for r in quality_rules(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = [x for x in re.split(SPACE, t) if x]
        lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_rules_plan_has_no_python_and_no_shuffle(spark):
    plan = quality_rules(documents(spark, ["a b"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Pandas|Arrow", plan)


def test_rules_on_null_ids_and_empty_tables(spark):
    assert [r.doc_id for r in quality_rules(documents(spark, ["a", None], [None, 5])).collect()] == [None, 5]
    assert quality_rules(documents(spark, ["a"]).limit(0)).count() == 0


def test_ids_are_the_tokenizer_s():
    model = Tokenizer.from_file(PATH)
    odd = [t for t in ODD if t] + ["It's WE'LL don't'S x's.", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑΣ. İ é.", "1234 a1b2, ½ 漢字!", "…... a…. ?!x!?"]
    for t, ids in zip(odd, encode(odd, PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(t, add_special_tokens=False).ids
    assert list(encode(["a b c d e a", "f g"], PATH, cache_words=3))[0] == list(encode(["a b c d e a"], PATH))[0]


def test_first_fit():
    rng = random.Random(3)
    for _ in range(20):
        sizes = sorted((rng.randrange(1, 101) for _ in range(rng.randrange(0, 60))), reverse=True)
        bins, offsets = first_fit(sizes, 100)
        used: list[int] = []
        for s, b, o in zip(sizes, bins, offsets, strict=True):
            k = next((k for k, u in enumerate(used) if u + s <= 100), len(used))
            used += [0] * (k == len(used))
            assert (b, o) == (k, used[k])
            used[k] += s


@pytest.mark.parametrize("group_rows", [5, 8192])
def test_packing_is_whole(spark, group_rows):
    rng = random.Random(5)
    texts = ODD + [" ".join(words(rng, rng.randrange(1, 3000))) for _ in range(25)]
    ids = [None, *range(1, len(texts) - 1), 1]
    rows = pack_documents(documents(spark, texts, ids), PATH, group_rows=group_rows).collect()
    model = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in zip(ids, texts, strict=True):
        tokens = np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(tokens), 2048):
            part = tokens[s : s + 2048]
            want[i, s, len(part), zlib.crc32(part.tobytes()), len(tokens)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_of_an_empty_table(spark):
    assert pack_documents(documents(spark, ["a"]).limit(0), PATH).count() == 0


def test_short_ways_only_where_they_hold():
    assert is_plain(Tokenizer.from_file(PATH))
    assert not is_plain(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_marks_after_letters_that_come_apart():
    texts = ["GAZETESİ.", "İ? İ* İ: İİ.", "क़. कक़! aक़|", "ÜÇ. ÉTÉ? straße! Å. ǅ, ﬁ."]
    model = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, encode(texts, PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids
