"""Substring dedup: suffix automata of reference shards, and documents' matching statistics.

A word goes if a window of 50 words that covers it also occurs in a document of a smaller id. All
documents are references for all others, so the automata are not broadcast whole: a shard is the
set of passages that one anchor brings together, and passages travel to their shard.

1. Each window's anchor is the smallest hash of its 8-word runs (winnowing): equal windows have
   equal anchors, and about one place in 22 is an anchor. Windows whose anchor occurs in one
   document only cannot repeat and are done.
2. The windows of a shared anchor, taken together, are a segment, of whole words. Equal segments
   become one row with the smallest id. A shard's distinct segments, in order of id, are put into
   suffix automata of a bounded number of segments, whose states remember the smallest id; streaming
   a segment through them gives, for each window, the smallest id in which the window occurs.
3. The spans so found go back to their documents, whose texts are shuffled once.

Exact copies are decided by a 128-bit hash of the whole text. The windows of an anchor with a vast
number of segments are segments of their own, dealt out by their 128-bit hashes: equal ones meet
there before any shuffle, and a segment of one window has nothing for an automaton to find. So no
group gathers in one task, and words are compared whole or in hashes of 128 bits.

Defined results: a null or short text loses nothing; words within one text never count against each
other; rows of the same id don't either; a row without an id loses what a row with an id has, and
takes nothing from others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, unused

#: Words in a run whose hash may be an anchor; a power of two.
RUN = 8
#: Segments from which on an anchor's windows are dealt out by their own hash. That makes up to 43 rows of a segment,
#: while a shard of this size is some 30 MB of words and, in a task, seconds for each automaton.
HOT = 20_000
#: Distinct segments in an automaton at most; a shard takes as many automata as it needs.
AUTOMATON = 1000
#: Windows in a segment at most.
LONGEST = 256
#: Distinct words whose hashes a task remembers.
CACHE_WORDS = 500_000


_PARTS = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(words: list[bytes], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window of `window` words, as a signed long."""
    with np.errstate(over="ignore"):
        run, step = h, 1
        while step < RUN:
            run = run[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + run[step:]
            run = run ^ (run >> np.uint64(29))
            step *= 2
        run = run * np.uint64(0xBF58476D1CE4E5B9)
        least = run ^ (run >> np.uint64(32))
    wide, span = window - RUN + 1, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        rest = wide - span
        least = np.minimum(least[:-rest], least[rest:])
    return least.view(np.int64)


def stretches(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of windows with one anchor, cut at LONGEST windows."""
    cuts = np.flatnonzero(a[1:] != a[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    ends = np.concatenate([cuts, [len(a)]])
    if (ends - starts).max() > LONGEST:
        starts = np.concatenate([np.arange(s, e, LONGEST) for s, e in zip(starts, ends, strict=True)])
        ends = np.append(starts[1:], len(a))
    return starts, ends


class Automaton:
    """A suffix automaton of several sequences, added in ascending order of key.

    A state's key is that of the first sequence with its substrings: a new state takes the key of the
    sequence being added, a clone that of its original.
    """

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]
        self.key = [0]

    def add(self, sequence: list[int], key: int) -> None:
        nxt, link, size, keys = self.next, self.link, self.size, self.key
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                if size[q] == size[last] + 1:
                    last = q
                else:
                    last = self._split(last, q, c)
                continue
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            keys.append(key)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if size[q] == size[p] + 1 else self._split(p, q, c)
            last = cur

    def _split(self, p: int, q: int, c: int) -> int:
        nxt, link = self.next, self.link
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        self.size.append(self.size[p] + 1)
        self.key.append(self.key[q])
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def first_keys(self, sequence: list[int], window: int) -> list[int | None]:
        """For each window of the sequence the smallest key with it; None if no sequence has it."""
        nxt, link, size, keys = self.next, self.link, self.size, self.key
        out: list[int | None] = []
        at, matched = 0, 0
        for i, c in enumerate(sequence):
            while at and c not in nxt[at]:
                at = link[at]
                matched = size[at]
            if c in nxt[at]:
                at = nxt[at][c]
                matched += 1
            while at and size[link[at]] >= window:
                at = link[at]
                matched = size[at]
            if i >= window - 1:
                out.append(keys[at] if matched >= window else None)
        return out


def identified(docs: DataFrame, name: str = "who") -> DataFrame:
    """`docs` with a column struct<deal, id, anon>.

    deal: a hash of id and text by which rows are dealt and joined; what it joins is compared by id
    and text id again. Rows without text are dealt by their place: they have nothing to join.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    deal = F.when(text.isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64(doc_id, text))
    return docs.withColumn(name, F.struct(deal.alias("deal"), F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("anon")))


def text_id(raw: bytes) -> tuple[int, int]:
    """128 bits of a text as two signed longs."""
    digest = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


_WHO = ["deal", "id", "anon", "t1", "t2"]


def survey(rows: DataFrame, window: int) -> DataFrame:
    """(deal, id, anon, t1, t2, n_words, anchors): of each row with a window, the anchors of its segments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for b in batches:
            out = []
            for deal, own, anon, text in zip(b["deal"], b["id"], b["anon"], b["text"], strict=True):
                raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
                words = raw.split()
                if len(words) >= window:
                    a = anchors(word_hashes(words, known), window)
                    out.append((deal, own, anon, *text_id(raw), len(words), a[stretches(a)[0]]))
            yield pd.DataFrame(out, columns=[*_WHO, "n_words", "anchors"])

    return rows.mapInPandas(run, "deal long, id long, anon boolean, t1 long, t2 long, n_words long, anchors array<long>")


def segments(rows: DataFrame, window: int) -> DataFrame:
    """(deal, id, anon, t1, t2, start, alone, route, seg, words): the segments of (deal, id, anon, text, shared, hot).

    alone: a single window of a hot anchor, whose words are not carried.
    """
    columns = [*_WHO, "start", "alone", "route", "seg", "words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for b in batches:
            out: list[tuple] = []
            for deal, own, anon, text, shared, hot in zip(*[b[c] for c in ("deal", "id", "anon", "text", "shared", "hot")], strict=True):
                if shared is None or not len(shared) or not isinstance(text, str):
                    continue
                raw = text.encode("utf-8", "replace")
                words = raw.split()
                if len(words) < window:
                    continue
                who = (deal, own, anon, *text_id(raw))
                a = anchors(word_hashes(words, known), window)
                starts, ends = stretches(a)
                mine = a[starts]
                keep = np.isin(mine, shared)
                starts, ends, mine = starts[keep], ends[keep], mine[keep]
                apart = np.isin(mine, hot) if hot is not None and len(hot) else np.zeros(len(mine), bool)
                for s, e, x, alone in zip(starts.tolist(), ends.tolist(), mine.tolist(), apart.tolist(), strict=True):
                    if alone:
                        for i in range(s, e):
                            out.append((*who, i, True, 0, xxhash.xxh3_128_digest(b" ".join(words[i : i + window])), b""))
                    else:
                        blob = b" ".join(words[s : e + window - 1])
                        out.append((*who, s, False, x, xxhash.xxh3_128_digest(blob), blob))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return rows.mapInPandas(run, "deal long, id long, anon boolean, t1 long, t2 long, start int, alone boolean, route long, seg binary, words binary")


def first_documents(distinct: DataFrame, window: int, automaton: int = AUTOMATON) -> DataFrame:
    """(seg, runs): for each distinct segment the runs of windows (from, to) and their smallest id.

    distinct: (route, words, first, owned, n); first counts where owned is true. A partition is sorted
    by route and id, and one shard after another is turned into automata; a shard of one segment
    needs none.
    """

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        if len(rows) == 1:
            words, first, owned, n = rows[0]
            if n > 1 and owned:
                yield xxhash.xxh3_128_digest(words), [{"f": 0, "t": words.count(b" ") + 2 - window, "m": first}]
            return
        codes: dict[bytes, int] = {}
        sequences = [[codes.setdefault(w, len(codes)) for w in words.split(b" ")] for words, _, _, _ in rows]
        least: list[list] = [[None] * (len(x) - window + 1) for x in sequences]
        sources = [(x, first) for x, (_, first, owned, _) in zip(sequences, rows, strict=True) if owned]
        for at in range(0, len(sources), automaton):  # ids ascend, so what an earlier automaton finds stays
            built = Automaton()
            for sequence, first in sources[at : at + automaton]:
                built.add(sequence, first)
            for i, sequence in enumerate(sequences):
                if None in least[i]:
                    least[i] = [new if old is None else old for old, new in zip(least[i], built.first_keys(sequence, window), strict=True)]
        for (words, first, owned, n), keys in zip(rows, least, strict=True):
            runs: list[dict] = []
            for i, m in enumerate(keys):
                if m is not None:
                    if runs and runs[-1]["m"] == m and runs[-1]["t"] == i:
                        runs[-1]["t"] = i + 1
                    else:
                        runs.append({"f": i, "t": i + 1, "m": m})
            if runs and (n > 1 or not owned or any(r["m"] != first for r in runs)):
                yield xxhash.xxh3_128_digest(words), runs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        route, rows, out = None, [], []
        for b in batches:
            for r, words, first, owned, n in zip(b["route"].tolist(), b["words"], b["first"].tolist(), b["owned"].tolist(), b["n"].tolist(), strict=True):
                if r != route:
                    if rows:
                        out += shard(rows)
                    route, rows = r, []
                rows.append((bytes(words), first, owned, n))
            yield pd.DataFrame(out, columns=["seg", "runs"])
            out = []
        if rows:
            out += shard(rows)
        yield pd.DataFrame(out, columns=["seg", "runs"])

    dealt = distinct.repartition("route").sortWithinPartitions("route", "first", "words")
    return dealt.mapInPandas(run, "seg binary, runs array<struct<f:int,t:int,m:long>>")


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = 50, who: str = "who", hot: int = HOT, automaton: int = AUTOMATON) -> tuple[DataFrame, DataFrame]:
    """`docs` dealt by its column `who` (see identified), and (deal, spans): the words to remove of the rows dealt so."""
    own = F.when(~F.col("anon"), F.col("id"))
    span = [F.col("id"), F.col("anon").cast("int").alias("anon"), F.col("t1"), F.col("t2")]
    texts = docs.select(f"{who}.deal", f"{who}.id", f"{who}.anon", F.col("text").cast("string").alias("text"))
    surveyed = scratch.keep(survey(texts, window))
    whole = surveyed.groupBy("t1", "t2").agg(F.min(own).alias("owner"))
    owned = surveyed.join(whole, ["t1", "t2"])
    copies = owned.where("owner is not null and (anon or id > owner)").select("deal", F.struct(*span, F.lit(0).alias("a"), F.col("n_words").cast("int").alias("b")).alias("span"))
    single = owned.where((F.col("owner").isNull() & F.col("anon")) | (own == F.col("owner"))).dropDuplicates(_WHO)
    places = single.select("deal", F.explode("anchors").alias("anchor"))
    # an anchor of one text alone has nothing to take from another
    shared = places.groupBy("anchor").agg(F.min("deal").alias("lo"), F.max("deal").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    met = places.join(shared.select("anchor", (F.col("n") > hot).alias("hot")), "anchor")
    flagged = scratch.keep(met.groupBy("deal").agg(F.collect_set("anchor").alias("shared"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot")))
    dealt = docs.repartition(F.col(f"{who}.deal"))
    met = dealt.select(f"{who}.deal", f"{who}.id", f"{who}.anon", F.col("text").cast("string").alias("text")).join(flagged, "deal")
    parts = scratch.keep(segments(met.select("deal", "id", "anon", "text", "shared", "hot"), window))  # two readers, and made by Python
    groups = parts.where("not alone").groupBy("route", "words").agg(F.min(own).alias("first"), F.count("*").alias("n"))
    groups = groups.select("route", "words", F.coalesce("first", F.lit(0)).alias("first"), F.col("first").isNotNull().alias("owned"), "n")
    found = first_documents(groups, window, automaton)
    windows = parts.where("alone").groupBy("seg").agg(F.min(own).alias("m"), F.count("*").alias("n")).where("m is not null and n > 1")
    found = found.union(windows.select("seg", F.array(F.struct(F.lit(0).alias("f"), F.lit(1).alias("t"), "m")).alias("runs")))
    spans = parts.select(*_WHO, "start", "seg").join(found, "seg").select(*_WHO, "start", F.explode("runs").alias("r")).where("anon or r.m < id")
    spans = spans.select("deal", F.struct(*span, (F.col("start") + F.col("r.f")).alias("a"), (F.col("start") + F.col("r.t") + (window - 1)).alias("b")).alias("span"))
    return dealt, spans.union(copies).groupBy("deal").agg(F.collect_set("span").alias("spans"))


def cut_out(words: list, me: tuple, spans) -> list:
    """`words` without the spans (id, anon, t1, t2, from, to) of this text."""
    gone = np.zeros(len(words) + 1, np.int64)
    for *own, a, b in spans:
        if tuple(own) == me:
            gone[a] += 1
            gone[min(b, len(words))] -= 1
    return [w for w, k in zip(words, np.cumsum(gone).tolist(), strict=False) if not k]


def substring_dedup(docs: DataFrame, window: int = 50, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of each row of `docs` (doc_id, text)."""
    return _apply(docs, window, "kept_text", False, **options)


def substring_digests(docs: DataFrame, window: int = 50, **options) -> DataFrame:
    """As substring_dedup, with the SHA-256 of the kept text in its place."""
    return _apply(docs, window, "kept_sha256", True, **options)


def substring_filter(docs: DataFrame, window: int = 50, **options) -> DataFrame:
    """`docs` with the repeated passages cut out of its texts.

    What is left keeps its white space: a text loses each removed run of words with the space behind
    it. A text left without a word goes with its row; one that loses nothing stays as it is. A column
    n_chars is brought up to date.
    """
    who = unused(docs, "_who")
    dealt, spans = repeated_spans(identified(docs, who), Scratch(docs.sparkSession, "substrings"), window, who, **options)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ids: pd.Series, anons: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, own, anon, marks in zip(texts, ids, anons, found, strict=True):
            if marks is not None and isinstance(text, str):
                raw = text.encode("utf-8", "replace")
                parts = _PARTS.findall(raw)  # each word with the space behind it
                lead = raw[: len(raw) - sum(map(len, parts))]
                left = cut_out(parts, (own, int(anon), *text_id(raw)), marks)
                if len(left) < len(parts):
                    text = (lead + b"".join(left)).decode("utf-8") if left else None
            out.append(text)
        return pd.Series(out, dtype=object)

    at, found, left = f"{who}d", f"{who}s", f"{who}t"
    spans = spans.select(F.col("deal").alias(at), _flat("spans").alias(found))
    joined = dealt.join(spans, F.col(f"{who}.deal") == F.col(at), "left")
    text = F.col("text").cast("string")
    joined = joined.withColumn(left, F.when(F.col(found).isNotNull(), cut(text, F.col(f"{who}.id"), F.col(f"{who}.anon"), F.col(found))).otherwise(text))
    kept = joined.where(F.col(found).isNull() | F.col(left).isNotNull()).withColumn("text", F.col(left))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _flat(column: str) -> Column:
    return F.transform(column, lambda s: F.array(s["id"], s["anon"].cast("long"), s["t1"], s["t2"], s["a"].cast("long"), s["b"].cast("long")))


def _apply(docs: DataFrame, window: int, kept: str, digest: bool, **options) -> DataFrame:
    rows = identified(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    dealt, spans = repeated_spans(rows, Scratch(docs.sparkSession, "substrings"), window, **options)
    kind = f"struct<n_words:long,n_removed:long,{kept}:string>"

    @F.pandas_udf(kind)
    def cut(texts: pd.Series, ids: pd.Series, anons: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for text, own, anon, marks in zip(texts, ids, anons, found, strict=True):
            raw = text.encode("utf-8", "replace") if isinstance(text, str) else b""
            words = raw.split()
            left = words if marks is None else cut_out(words, (own, int(anon), *text_id(raw)), marks)
            line = b" ".join(left)
            out.append((len(words), len(words) - len(left), hashlib.sha256(line).hexdigest() if digest else line.decode("utf-8")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", kept])

    joined = dealt.join(spans, F.col("who.deal") == F.col("deal"), "left")
    return joined.select("doc_id", cut("text", F.col("who.id"), F.col("who.anon"), _flat("spans")).alias("c")).select("doc_id", "c.*")
