"""DuckDB SQL with the results of the queries in queries.py."""

from __future__ import annotations

from corpusloom.functions.text import STOP_WORDS
from corpusloom.operators.answer import RULE
from corpusloom.plans.queries import DIRT, GATE
from corpusloom.plans.sample import PAGES, QUESTIONS

_BLANKS = r"\x{9}\x{B}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACES = _BLANKS + r"\x{A}"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_ORD = 1 << 24


def _lit(s: str) -> str:
    return "concat('', " + ", ".join(f"chr({ord(c)})" for c in s) + ")" if s else "''"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{_SPACES}]+|[{_SPACES}]+\z', '', 'g')"


def _unmarked(x: str) -> str:
    return f"replace(replace({x}, chr(65279), ''), chr(8203), '')"


def _clean(x: str) -> str:
    x = f"replace({_unmarked(x)}, chr(160), ' ')"
    x = f"replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(9), ' ')"
    x = f"regexp_replace({x}, '[{_BLANKS}]*\\n[{_BLANKS}]*', chr(10), 'g')"
    x = f"regexp_replace({_strip(x)}, '[{_BLANKS}]{{2,}}', ' ', 'g')"
    return f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def _fold(x: str) -> str:
    return _strip(f"regexp_replace({x}, '[{_SPACES}]+', ' ', 'g')")


def _tokens(x: str, stop: bool = True) -> str:
    found = rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
    return f"list_filter({found}, lambda w: w NOT IN ({_STOP}))" if stop else found


def _cut(source: str, size: int, overlap: int, keep: str) -> str:
    """Windows of column t of `source`."""
    step = size - overlap
    return f"""(SELECT {keep}, i, i * {step} AS start, substr(t, i * {step} + 1, {size}) AS content FROM (
  SELECT *, unnest(range(0, CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= {size} THEN 1 ELSE 1 + ceil((len(t) - {size}) / {step}.0)::BIGINT END)) AS i FROM {source}))"""


def _values(rows: list[tuple]) -> str:
    quoted = [", ".join(str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) for r in rows]
    return "(VALUES " + ", ".join(f"({r})" for r in quoted) + ")"


def _sample() -> str:
    """The library's small set of documents and questions: its documents are shorter than a chunk."""
    texts = {p[1]: (p[2], "\n\n".join(x[5] for x in PAGES if x[1] == p[1])) for p in PAGES}
    names = [(q[0], n) for q in QUESTIONS for n in q[3]]
    return f"""chunks AS (SELECT d * {_ORD} AS chunk_ord, d AS doc_id, name, content FROM {_values([(d, n, t) for d, (n, t) in texts.items()])} t(d, name, content)),
{_INDEX[len(_CHUNKS) + 2 :]}, qs AS (SELECT * FROM {_values([q[:3] for q in QUESTIONS])} t(query_id, category, query)), wanted AS (SELECT * FROM {_values(names)} t(query_id, document_name)),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens("query")}) AS term FROM qs) GROUP BY ALL),
scored AS (SELECT query_id, chunk_ord, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qterms JOIN posts USING (term) JOIN dfs USING (term), corpus GROUP BY ALL),
hits AS (SELECT h.query_id, rank, name AS document_name FROM {_top('scored', 5)} h JOIN chunks USING (chunk_ord)),
m AS (SELECT query_id, category, (SELECT count(*) FROM wanted w WHERE w.query_id = qs.query_id) AS ne, (SELECT count(*) FROM hits h WHERE h.query_id = qs.query_id) AS nr,
  (SELECT count(*) FROM hits h JOIN wanted w USING (query_id, document_name) WHERE h.query_id = qs.query_id) AS ng, (SELECT min(rank) FROM hits h JOIN wanted w USING (query_id, document_name) WHERE h.query_id = qs.query_id) AS fr FROM qs)"""


def _coded(side: str) -> str:
    """Words as single ASCII characters by their place in d; a pair here has fewer than 90."""
    return f"array_to_string(list_transform({side}, lambda w: chr(32 + list_position(d, w))), '')"


#: Chunks of documents: doc_id, chunk_index, chunk_id, chunk_ord, content.
_CHUNKS = f"""cleaned AS MATERIALIZED (SELECT doc_id, lang, source, n_chars, {_clean("coalesce(text, '')")} AS t FROM documents),
chunks AS MATERIALIZED (SELECT doc_id, lang, source, i AS chunk_index, doc_id || '#' || i AS chunk_id, doc_id * {_ORD} + i AS chunk_ord, content
  FROM {_cut("cleaned", 1000, 200, "doc_id, lang, source")})"""

_INDEX = f"""{_CHUNKS},
toks AS MATERIALIZED (SELECT chunk_ord, doc_id, {_tokens("content")} AS ws FROM chunks),
posts AS MATERIALIZED (SELECT term, chunk_ord, dl, count(*) AS tf FROM (SELECT chunk_ord, len(ws) AS dl, unnest(ws) AS term FROM toks) GROUP BY ALL),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM posts GROUP BY term),
corpus AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS avgdl FROM toks)"""

_QUESTIONS = f"""qs AS (SELECT item_id AS query_id, text AS query FROM benchmark),
qterms AS MATERIALIZED (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens(_strip(_unmarked("query")))}) AS term FROM qs) GROUP BY ALL)"""

_SCORES = f"""{_INDEX}, {_QUESTIONS},
scored AS MATERIALIZED (SELECT query_id, chunk_ord, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qterms JOIN posts USING (term) JOIN dfs USING (term), corpus GROUP BY ALL)"""


def _top(source: str, k: int, where: str = "score > 0") -> str:
    return f"""(SELECT * FROM (SELECT query_id, chunk_ord, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_ord)::INT AS rank
  FROM {source} WHERE {where}) WHERE rank <= {k})"""


_SHOWN = "query_id, rank, chunk_ord, round(score, 6) AS score"


def _named(k: int) -> str:
    return f"(SELECT h.*, c.doc_id, c.chunk_id, c.content, 'doc-' || c.doc_id AS document_name, 1 AS page_number FROM {_top('scored', k)} h JOIN chunks c USING (chunk_ord))"


def _hashed(x: str, keys: str, source: str) -> str:
    """Rows (keys, bucket, w) of the hashing embedder."""
    return f"""(SELECT *, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY {keys})) AS w FROM (
  SELECT {keys}, ('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS bucket, count(*)::DOUBLE AS w0 FROM (SELECT {keys}, unnest({_tokens(x, False)}) AS tok FROM {source}) GROUP BY ALL))"""


_DENSE = f"""cv AS MATERIALIZED {_hashed("content", "chunk_ord", "chunks")},
qv AS MATERIALIZED {_hashed(_strip("query"), "query_id", "qs")},
dense AS MATERIALIZED (SELECT query_id, chunk_ord, sum(a.w * b.w) AS score FROM qv a JOIN cv b USING (bucket) GROUP BY ALL)"""


def _fused(semantic: str | None, keyword: str | None, weights: tuple[float, float], k: int) -> str:
    sides = [f"SELECT query_id, chunk_id, chunk_ord, {w} / (60 + rank) AS part, {'rank' if i == 0 else 'NULL'} AS sr, {'rank' if i else 'NULL'} AS kr FROM {s}" for i, (s, w) in enumerate(zip((semantic, keyword), weights, strict=True)) if s]
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, chunk_id)::INT AS rank FROM (
  SELECT query_id, chunk_id, min(chunk_ord) AS chunk_ord, sum(part) AS s, max(sr)::INT AS semantic_rank, max(kr)::INT AS keyword_rank FROM ({" UNION ALL ".join(sides)}) GROUP BY ALL)) WHERE rank <= {k})"""


def _ids(x: str) -> str:
    return f"(SELECT *, (chunk_ord // {_ORD}) || '#' || (chunk_ord % {_ORD}) AS chunk_id FROM {x})"


_HYBRID = f"WITH {_SCORES}, {_DENSE}"
_BOTH = _fused(_ids(_top("dense", 20, "true")), _ids(_top("scored", 20)), (1.0, 1.0), 10)

_VECTORS = """v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)"""


def _pairs(every: int) -> str:
    return f"(SELECT q.vec_id AS query_id, c.vec_id AS chunk_ord, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score FROM u q, u c WHERE q.vec_id % {every} = 0)"


_EXPECTED = "wanted AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, 'doc-' || doc_id AS document_name FROM benchmark, documents WHERE contains(documents.text, benchmark.text))"


def _measures(hits: str) -> str:
    """Measures of each question for hits (query_id, rank, chunk_ord)."""
    return f"""(SELECT query_id, 'group ' || (query_id % 5) AS category, ne > 0 AS relevant, nr AS n_returned,
  CASE WHEN ne > 0 AND ng > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, CASE WHEN ne > 0 THEN nd / ne ELSE 0.0 END::DOUBLE AS recall,
  CASE WHEN ne > 0 AND nr > 0 THEN ng / nr ELSE 0.0 END::DOUBLE AS precision, CASE WHEN ne > 0 AND fr IS NOT NULL THEN 1 / fr ELSE 0.0 END::DOUBLE AS reciprocal_rank, nr = 0 AS rejected
FROM (SELECT qs.query_id, (SELECT count(*) FROM wanted w WHERE w.query_id = qs.query_id) AS ne, coalesce(nr, 0) AS nr, coalesce(ng, 0) AS ng, coalesce(nd, 0) AS nd, fr FROM qs LEFT JOIN (
  SELECT h.query_id, count(*) AS nr, count(w.document_name) AS ng, count(DISTINCT w.document_name) AS nd, min(rank) FILTER (w.document_name IS NOT NULL) AS fr
  FROM (SELECT *, 'doc-' || (chunk_ord // {_ORD}) AS document_name FROM {hits}) h LEFT JOIN wanted w USING (query_id, document_name) GROUP BY h.query_id) x USING (query_id)))"""


_SUMMARY = """count(*) AS n_queries, count(*) FILTER (relevant) AS n_relevant, round(coalesce(avg(hit) FILTER (relevant), 0), 6) AS hit_rate, round(coalesce(avg(recall) FILTER (relevant), 0), 6) AS recall,
  round(coalesce(avg(precision) FILTER (relevant), 0), 6) AS precision, round(coalesce(avg(reciprocal_rank) FILTER (relevant), 0), 6) AS mrr,
  round(coalesce(avg(rejected::INT) FILTER (NOT relevant), 1), 6) AS rejection_rate, round(avg(n_returned), 6) AS avg_returned"""

_KEYWORD_MEASURES = _measures(_top("scored", 5, "score > 0 AND score >= 30"))

_META = "CASE doc_id % 9 WHEN 0 THEN '3.0' WHEN 1 THEN '3.5' WHEN 2 THEN 'true' WHEN 3 THEN '0' WHEN 4 THEN '-2' WHEN 5 THEN 'nan' WHEN 6 THEN NULL ELSE doc_id::VARCHAR END"
_PAGE = "CASE WHEN regexp_matches(m, '^[0-9]+(\\.0*)?$') AND m::DOUBLE >= 1 THEN m::DOUBLE::INT END"

_BOOKS = f"""p0 AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS page_number, {_clean("text")} AS c FROM documents),
p AS MATERIALIZED (SELECT *, (sum(len(c) + 2) OVER (PARTITION BY source ORDER BY page_number) - 2)::INT AS "end" FROM p0 WHERE c <> ''),
books AS MATERIALIZED (SELECT source, string_agg(c, chr(10) || chr(10) ORDER BY page_number) AS t FROM p GROUP BY source)"""


def _page_at(rows: str, offset: str) -> str:
    """rows with the page of column `offset`: the first that ends behind it, else the last."""
    return f"(SELECT r.*, coalesce(min(p.page_number) FILTER (p.\"end\" > r.{offset}), max(p.page_number)) AS page_number FROM {rows} r JOIN p ON p.source = r.source GROUP BY ALL)"


_SPOILED = "replace(replace({0}, 'th', 't'), 'er ', 'e r')"
_ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', 'e', 'g')"

_ROWS = "rows_ AS (SELECT o_orderkey::VARCHAR AS chunk_id, o_custkey::VARCHAR AS document_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END AS document_name, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS content, o_orderkey AS batch_pos FROM orders)"

_FILES = """f AS (SELECT doc_id, ['.pdf', '.pdf', '.docx', '.png', '.jpg', '.jpeg', '.txt', ''][doc_id % 8 + 1] AS sfx, CASE WHEN doc_id % 13 > 0 THEN n_chars ELSE 0 END AS length,
  ['pdf', 'docx', 'png', 'jpeg'][doc_id % 4 + 1] AS magic FROM documents)"""

_WORDS = """w AS (SELECT item_id AS doc, unnest(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> ''), 1) - 1 AS i
  FROM benchmark WHERE item_id % 10 <> 9),
good AS (SELECT doc, word, i, i // 24 AS block, (i // 12) % 2 AS par, (i // 4) % 3 AS line, (i % 4) * 100 + CASE WHEN i % 7 = 3 THEN 60 ELSE 0 END AS l, CASE WHEN i % 9 = 8 THEN -1 ELSE 90 - i % 9 END AS conf, i % 17 = 16 AS broken FROM w)"""


def _pack(source: str) -> str:
    header = "'[Chunk ' || i || '] | Document: ' || document_name || ' | Page: ' || page_number || ' | Chunk ID: ' || chunk_id || chr(10) || content"
    return f"""packed AS (SELECT *, sum(len(p) + CASE WHEN i > 1 THEN {len(RULE)} ELSE 0 END) OVER (PARTITION BY query_id ORDER BY i) AS chars FROM (
  SELECT *, {header} AS p FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM {source}))),
context AS (SELECT query_id, string_agg(p, {_lit(RULE)} ORDER BY i) AS context, count(*) AS n_used FROM packed WHERE i = 1 OR chars <= 3000 GROUP BY query_id)"""


def _answers(source: str, cited: str) -> str:
    """Reports on all questions of hits with names, and how a source is cited."""
    return f"""{_pack(source)}, n AS (SELECT query_id, count(*) AS n_hits, list({cited} ORDER BY rank) AS sources FROM {source} GROUP BY query_id)
SELECT qs.query_id, CASE WHEN n_used IS NULL THEN 'insufficient_context' ELSE 'ok' END AS status, CASE WHEN n_used IS NOT NULL THEN {_strip("(SELECT content FROM packed WHERE packed.query_id = qs.query_id AND i = 1)")} END AS answer, coalesce(n_hits, 0) AS n_hits, coalesce(n_used, 0) AS n_used, coalesce(sources, []) AS sources
FROM qs LEFT JOIN n USING (query_id) LEFT JOIN context USING (query_id)"""


_OVERLAP = f"coalesce(len(list_intersect(list_distinct({_tokens('query', False)}), {_tokens('content', False)})) / nullif(len(list_distinct({_tokens('query', False)})), 0), 0)"


def _reranked(hits: str, k: int) -> str:
    """The k best of hits (query_id, rank, chunk_ord) by the share of the question's words."""
    return f"""(SELECT * FROM (SELECT * EXCLUDE (r0), row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, r0, chunk_id)::INT AS rank FROM (
  SELECT h.query_id, h.rank AS r0, c.chunk_ord, c.doc_id, c.chunk_id, c.content, 'doc-' || c.doc_id AS document_name, 1 AS page_number, {_OVERLAP} AS rr FROM {hits} h JOIN chunks c USING (chunk_ord) JOIN qs USING (query_id))) WHERE rank <= {k})"""


_DENSE_20 = _top("dense", 20, f"score >= {GATE}")
_WORDS_20 = _top("scored", 20)
_FUSED_20 = _fused(_ids(_DENSE_20), _ids(_WORDS_20), (1.0, 1.0), 20)


def _first(hits: str, k: int) -> str:
    return f"(SELECT * FROM {hits} WHERE rank <= {k})"


_MODES = {"semantic": _first(_DENSE_20, 5), "semantic_rerank": _reranked(_DENSE_20, 5), "keyword": _first(_WORDS_20, 5), "hybrid": _first(_FUSED_20, 5), "hybrid_rerank": _reranked(_FUSED_20, 5)}

_READ = """r0 AS (SELECT item_id AS k, list_filter(regexp_split_to_array(regexp_replace(text, '[^\\x00-\\x7F]', 'e', 'g'), '[ \\n]+'), lambda x: x <> '') AS w FROM benchmark),
r1 AS (SELECT k, array_to_string(w[:(len(w) + 1) // 2], ' ') AS a, array_to_string(w[(len(w) + 1) // 2 + 1:], ' ') AS b FROM r0),"""


ORACLES: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_clean(f'{_lit(DIRT[0][0])} || replace(replace(text, {_lit(DIRT[1][0])}, {_lit(DIRT[1][1])}), {_lit(DIRT[2][0])}, {_lit(DIRT[2][1])}) || chr(8203) || {_lit(chr(32) + chr(10))}')} AS clean FROM documents",
    "tokenize": f"SELECT doc_id, len(ws)::INT AS n_tokens, array_to_string(ws, ' ') AS tokens FROM (SELECT doc_id, {_tokens('text')} AS ws FROM documents)",
    "alnum_count": r"SELECT doc_id, len(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g'))::INT AS n FROM documents",
    "validate_query": f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' ' || chr(8203) || chr(10) WHEN doc_id % 11 = 0 THEN NULL ELSE chr(65279) || ' ' || text END AS q FROM documents)
SELECT doc_id, CASE WHEN q IS NULL THEN 'invalid_query:missing' WHEN len(q) > 10000 THEN 'invalid_query:too_long' WHEN {_strip(_unmarked("q"))} = '' THEN 'invalid_query:empty' END AS error,
  len({_strip("q")})::INT AS n_semantic, len({_strip(_unmarked("q"))})::INT AS n_keyword FROM r""",
    "validate_question": f"""WITH r AS (SELECT conv_id, turn, {_strip(_unmarked("CASE WHEN turn % 5 = 4 THEN chr(8203) || ' ' ELSE repeat(' ', 9990) || text END"))} AS q FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN q = '' THEN 'invalid_query:empty' WHEN len(q) > 10000 THEN 'invalid_query:too_long' END AS error FROM r""",
    "normalize_text": f"SELECT doc_id, {_fold('nfc_normalize(replace(replace(text, chr(233), chr(101) || chr(769)), chr(32), chr(9) || chr(160)))')} AS normal FROM documents",
    "cer": f"SELECT item_id, round(levenshtein(r, h) / len(r), 6) AS cer FROM (SELECT item_id, {_fold('r')} AS r, {_fold(_SPOILED.format('r'))} AS h FROM (SELECT item_id, {_ASCII} AS r FROM benchmark))",
    # words become single ASCII characters, of which a pair needs fewer than 90
    "wer": f"""WITH p AS (SELECT item_id, string_split(r, ' ') AS r, string_split(h, ' ') AS h, list_distinct(string_split(r, ' ') || string_split(h, ' ')) AS d FROM (SELECT item_id, {_fold('text')} AS r, {_fold(_SPOILED.format('text'))} AS h FROM benchmark))
SELECT item_id, round(levenshtein(array_to_string(list_transform(r, lambda w: chr(32 + list_position(d, w))), ''), array_to_string(list_transform(h, lambda w: chr(32 + list_position(d, w))), '')) / len(r), 6) AS wer FROM p""",
    "extract_page_number": f"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND m IS NULL THEN 5 ELSE {_PAGE} END::INT AS page FROM (SELECT doc_id, {_META} AS m FROM documents)""",
    "build_prompt": f"SELECT conv_id, turn, 2 AS n, 'system' AS first_role, {_lit('QUESTION:' + chr(10))} || {_strip('text')} || {_lit(chr(10) * 2 + 'CONTEXT:' + chr(10))} || 'turn ' || turn || {_lit(chr(10) * 2 + 'Answer:')} AS \"user\" FROM conversations WHERE role = 'user'",
    "flatten_metadata": f"""SELECT doc_id, array_to_string(list_sort(list_filter(['chunk_id=' || doc_id || '#0', 'document_id=' || doc_id, CASE WHEN doc_id % 3 > 0 THEN 'page_number=' || (doc_id % 3) END, 'lang=' || lang,
  CASE WHEN m <> 'nan' THEN 'weight=' || m END], lambda x: x IS NOT NULL)), ';') AS meta FROM (SELECT doc_id, lang, {_META} AS m FROM documents)""",
    "page_boundaries": f'WITH {_BOOKS} SELECT source AS document_id, page_number, ("end" - len(c))::INT AS start, "end" FROM p',
    "split_text": f"WITH d AS (SELECT doc_id, text AS t FROM documents) SELECT doc_id, i::INT AS i, start::INT AS start, content FROM {_cut('d', 300, 50, 'doc_id')}",
    "page_for_offset": f"WITH {_BOOKS}, o AS (SELECT source, unnest(range(0, len(t) + 501, 997)) AS off FROM books) SELECT source AS document_id, off::INT AS \"offset\", page_number FROM {_page_at('o', 'off')}",
    "chunk_document": f"WITH {_BOOKS}, c AS {_cut('books', 1000, 200, 'source')} SELECT source AS document_id, source || '#' || i AS chunk_id, i::INT AS chunk_index, page_number, start::INT AS start, content FROM {_page_at('c', 'start')}",
    "chunk_metadata": f"WITH {_CHUNKS} SELECT chunk_id, lang, source, len(content)::VARCHAR AS char_count, '1000' AS chunk_size, '200' AS chunk_overlap, 5 AS n_keys FROM chunks",
    "bm25_postings": f"WITH {_INDEX} SELECT term, chunk_ord, dl::INT AS dl, tf FROM posts",
    "bm25_df": f"WITH {_INDEX} SELECT * FROM dfs",
    "bm25_corpus_stats": f"WITH {_INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM corpus",
    "bm25_score": f"WITH {_SCORES} SELECT query_id, chunk_ord, round(score, 6) AS score FROM scored",
    "bm25_topk": f"WITH {_SCORES} SELECT {_SHOWN} FROM {_top('scored', 10)}",
    "bm25_min_score": f"WITH {_SCORES} SELECT {_SHOWN} FROM {_top('scored', 20, 'score > 0 AND score >= 12')}",
    "bm25_remove_document": f"WITH {_INDEX} SELECT count(*) FILTER (doc_id <> 0) AS n, round(sum(len(ws)) FILTER (doc_id <> 0) / count(*) FILTER (doc_id <> 0), 6) AS avgdl, count(*) FILTER (doc_id = 0) AS removed FROM toks",
    "embed_hashing": f"SELECT doc_id, bucket::INT AS bucket, round(w, 6) AS w FROM {_hashed('text', 'doc_id', 'documents')}",
    "vector_topk": f"WITH {_VECTORS} SELECT {_SHOWN} FROM {_top(_pairs(20), 10, 'true')}",
    "semantic_min_score": f"WITH {_VECTORS} SELECT {_SHOWN} FROM {_top(_pairs(20), 20, 'score >= 0.3')}",
    "rrf_fusion": f"""WITH {_VECTORS}, same AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_ord, 1.0 AS score FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, chunk_id, round(s, 8) AS score, semantic_rank, keyword_rank FROM {_fused(f"(SELECT *, lpad(chunk_ord::VARCHAR, 9, '0') AS chunk_id FROM {_top(_pairs(50), 20, 'true')})", f"(SELECT *, lpad(chunk_ord::VARCHAR, 9, '0') AS chunk_id FROM {_top('same', 20)})", (1.0, 0.5), 15)}""",
    "hybrid_topk": f"{_HYBRID} SELECT query_id, rank, chunk_id, round(s, 8) AS score FROM {_BOTH}",
    "hybrid_weighted": f"{_HYBRID} SELECT query_id, rank, chunk_id, round(s, 8) AS score FROM {_fused(_ids(_top('dense', 20, 'true')), _ids(_top('scored', 20)), (0.5, 2.0), 10)}",
    "hybrid_one_sided": f"WITH {_SCORES} SELECT query_id, rank, chunk_id, round(s, 8) AS score FROM {_fused(None, _ids(_top('scored', 20)), (0.0, 2.0), 10)}",
    "rerank_candidates": f"WITH {_SCORES} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM {_named(20)}",
    "rerank_topk": f"""WITH {_SCORES}, c AS (SELECT h.*, {_OVERLAP} AS rr FROM {_named(20)} h JOIN qs USING (query_id))
SELECT query_id, r AS rank, chunk_id, round(score, 6) AS retrieval_score, round(rr, 6) AS reranker_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rr DESC, rank, chunk_id)::INT AS r FROM c) WHERE r <= 5""",
    "relevance_gate": f"""WITH {_VECTORS}, h AS (SELECT query_id, count(*) AS n FROM {_top(_pairs(10), 10, 'true')} WHERE round(score, 6) >= 0.35 GROUP BY query_id)
SELECT vec_id AS query_id, coalesce(n, 0) AS n_hits, CASE WHEN n > 0 THEN 'ok' ELSE 'insufficient_context' END AS status FROM embeddings LEFT JOIN h ON query_id = vec_id WHERE vec_id % 10 = 0""",
    "context_pack": f"WITH {_SCORES}, {_pack(_named(10))} SELECT * FROM context",
    "format_sources": f"""WITH {_SCORES}, h AS (SELECT query_id, rank, round(score, 6) AS score, chunk_ord // {_ORD} AS doc FROM {_top('scored', 10)}),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY rank) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INT AS position, 'c' || doc AS chunk_id, doc::VARCHAR AS document_id, 'doc-' || doc AS document_name, nullif(doc % 4, 0)::INT AS page_number, score, CASE WHEN doc % 3 > 0 THEN (doc % 3)::DOUBLE END AS reranker_score FROM o""",
    "answer_report": f"WITH {_SCORES}, {_answers(_named(10), 'chunk_id')}",
    "answer_semantic": f"{_HYBRID}, best AS MATERIALIZED {_reranked(_DENSE_20, 5)}, {_answers('best', "chunk_id || '#1'")}",
    "answer_keyword": f"WITH {_SCORES}, best AS MATERIALIZED {_reranked(_WORDS_20, 5)}, {_answers('best', "chunk_id || '#1'")}",
    "answer_hybrid": f"{_HYBRID}, best AS MATERIALIZED {_reranked(_FUSED_20, 5)}, {_answers('best', "chunk_id || '#1'")}",
    "scan_chunks": f"WITH {_ROWS} SELECT chunk_id, document_id, coalesce(document_name, 'unknown_file') AS document_name, coalesce(content, '') AS content, 0.0::DOUBLE AS score FROM rows_",
    "upsert_last_wins": f"""WITH {_ROWS}, k AS (SELECT *, CASE WHEN batch_pos % 64 = 0 THEN -batch_pos ELSE batch_pos - batch_pos % 32 END AS k FROM rows_ WHERE batch_pos % 4 = 0),
b AS (SELECT k::VARCHAR AS chunk_id, document_id, document_name, 'new' AS content, batch_pos FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY batch_pos DESC) = 1)
SELECT * FROM rows_ WHERE chunk_id NOT IN (SELECT chunk_id FROM b) UNION ALL SELECT * FROM b""",
    "reindex_replace": f"""WITH {_ROWS}, b AS (SELECT * FROM rows_ WHERE batch_pos % 50 = 1), a AS (SELECT document_id, content FROM rows_ WHERE document_id NOT IN (SELECT document_id FROM b) UNION ALL SELECT document_id, 'again' FROM b)
SELECT document_id, count(*) AS n, count(*) FILTER (content = 'again') AS again FROM a GROUP BY document_id""",
    "delete_document": f"WITH {_ROWS} SELECT count(*) FILTER (document_id <> '7') AS remaining, count(*) FILTER (document_id = '7') AS removed FROM rows_",
    "store_count": f"WITH {_CHUNKS} SELECT count(*) AS n FROM chunks",
    "indexing_report": f"WITH {_CHUNKS} SELECT d.doc_id::VARCHAR AS document_id, 'doc-' || d.doc_id AS document_name, 1::BIGINT AS n_pages, count(c.doc_id) AS n_chunks, CASE WHEN count(c.doc_id) > 0 THEN 'ok' ELSE 'no_chunks' END AS status FROM documents d LEFT JOIN chunks c USING (doc_id) GROUP BY d.doc_id",
    "index_from_store": f"WITH {_INDEX} SELECT count(*) FILTER (doc_id <> 0) AS n, round(sum(len(ws)) FILTER (doc_id <> 0) / count(*) FILTER (doc_id <> 0), 6) AS avgdl FROM toks",
    "eval_per_query": f"WITH {_SCORES}, {_EXPECTED} SELECT query_id, category, relevant, n_returned, round(hit, 6) AS hit, round(recall, 6) AS recall, round(precision, 6) AS precision, round(reciprocal_rank, 6) AS reciprocal_rank, rejected FROM {_KEYWORD_MEASURES}",
    "eval_summary": f"WITH {_SCORES}, {_EXPECTED} SELECT {_SUMMARY} FROM {_KEYWORD_MEASURES}",
    "eval_by_category": f"WITH {_SCORES}, {_EXPECTED} SELECT category, {_SUMMARY} FROM {_KEYWORD_MEASURES} GROUP BY category",
    "eval_mode_comparison": f"""{_HYBRID}, {_EXPECTED}, s AS ({" UNION ALL ".join(f"SELECT '{m}' AS mode, {_SUMMARY} FROM {_measures(h)}" for m, h in _MODES.items())}),
l AS (UNPIVOT (SELECT mode, hit_rate, recall, precision, mrr, rejection_rate FROM s) ON hit_rate, recall, precision, mrr, rejection_rate INTO NAME measure VALUE value)
SELECT l.mode, l.measure, l.value, round(l.value - b.value, 6) AS overhead FROM l LEFT JOIN l b ON l.mode = b.mode || '_rerank' AND b.measure = l.measure""",
    "eval_sample": f"""WITH {_sample()} SELECT query_id::BIGINT AS query_id, category, ne > 0 AS relevant, nr AS n_returned, (ng > 0)::INT::DOUBLE AS hit, CASE WHEN ne > 0 THEN round(ng / ne, 6) ELSE 0 END AS recall,
  CASE WHEN ne > 0 AND nr > 0 THEN round(ng / nr, 6) ELSE 0 END AS precision, coalesce(round(1 / fr, 6), 0) AS reciprocal_rank, nr = 0 AS rejected FROM m""",
    "latency_percentiles": """SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(list_sort(list(value))[least((count(*) * 95) // 100, count(*) - 1) + 1], 6) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type""",
    "timing_stats": "SELECT event_type, round(avg(v), 2) AS mean, round(median(v), 2) AS median, round(min(v), 2) AS min, round(max(v), 2) AS max FROM (SELECT event_type, round(value, 1) AS v FROM events) GROUP BY event_type",
    "ocr_macro_error": f"""WITH t AS (SELECT {_fold('r')} AS r, {_fold(_SPOILED.format('r'))} AS h FROM (SELECT {_ASCII} AS r FROM benchmark)),
p AS (SELECT *, string_split(r, ' ') AS rw, string_split(h, ' ') AS hw, list_distinct(string_split(r, ' ') || string_split(h, ' ')) AS d FROM t)
SELECT count(*) AS n, round(avg(levenshtein(r, h) / len(r)), 6) AS macro_cer, round(avg(levenshtein({_coded('rw')}, {_coded('hw')}) / len(rw)), 6) AS macro_wer FROM p""",
    "ocr_evaluation": f"""WITH {_READ}
r2 AS (SELECT k, CASE WHEN k % 3 = 0 THEN [a] ELSE [a, b] END AS truth, CASE WHEN k % 3 = 0 THEN [{_SPOILED.format('a')}] WHEN k % 7 = 3 THEN [{_SPOILED.format('a')}, {_SPOILED.format('b')}, 'more'] ELSE [{_SPOILED.format('a')}, {_SPOILED.format('b')}] END AS pages FROM r1),
r3 AS (SELECT *, array_to_string(truth, chr(10) || chr(10)) AS ref, array_to_string(pages, chr(10) || chr(10)) AS hyp, {_fold("array_to_string(truth, ' ')")} AS r, {_fold("array_to_string(pages, ' ')")} AS h FROM r2),
p AS (SELECT *, string_split(r, ' ') AS rw, string_split(h, ' ') AS hw, list_distinct(string_split(r, ' ') || string_split(h, ' ')) AS d FROM r3),
e AS (SELECT k, string_agg(format('{{:.4f}}', round(CASE WHEN coalesce(truth[i], '') = '' THEN CASE WHEN {_fold('pages[i]')} = '' THEN 0 ELSE 1 END ELSE levenshtein({_fold('truth[i]')}, {_fold('pages[i]')}) / len({_fold('truth[i]')}) END, 4)), ', ' ORDER BY i) AS c
  FROM (SELECT k, truth, pages, unnest(range(1, len(pages) + 1)) AS i FROM r2 WHERE len(pages) > 1) GROUP BY k)
SELECT k AS doc, len(pages)::INT AS n_pages, len(ref)::INT AS reference_chars, len(hyp)::INT AS hypothesis_chars, round(levenshtein(r, h) / len(r), 6) AS cer, round(levenshtein({_coded('rw')}, {_coded('hw')}) / len(rw), 6) AS wer, '[' || c || ']' AS page_cers FROM p LEFT JOIN e USING (k)""",
    "token_presence": "SELECT doc_id, round((" + " + ".join(f"contains(text, '{t}')::INT" for t in ("the", "ing", "de", "que", "|", "!!")) + ") / 6, 6) AS share, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) = 4 AS four_rows FROM documents",
    "ingest_validate": f"WITH {_FILES} SELECT doc_id, CASE WHEN length = 0 THEN 'empty_file' WHEN length > 5000 THEN 'file_too_large' WHEN sfx IN ('', '.txt') THEN 'unsupported_format' END AS error FROM f",
    "detect_format": f"""WITH {_FILES} SELECT doc_id, CASE WHEN ok THEN magic END AS format, CASE WHEN ok THEN NULL WHEN sfx IN ('', '.txt') THEN 'unsupported_format' ELSE 'content_mismatch' END AS error_code
FROM (SELECT *, (magic = 'pdf' AND sfx = '.pdf') OR (magic = 'docx' AND sfx = '.docx') OR (magic = 'png' AND sfx = '.png') OR (magic = 'jpeg' AND sfx IN ('.jpg', '.jpeg')) AS ok FROM f)""",
    "docx_table_text": "SELECT n_nationkey, n_name || ' | ' || r_name || ' | ' || n_regionkey AS line FROM nation JOIN region ON n_regionkey = r_regionkey",
    "image_coverage": """WITH i AS (SELECT DISTINCT user_id, event_id % 11 AS x, CASE WHEN user_id % 17 = 0 THEN 0.0 ELSE 792.0 END::DOUBLE AS ph FROM events),
r AS (SELECT user_id, ph, greatest(least(x * 60.0 + (user_id % 5) * 30, 612) - greatest(x * 60.0 - 30, 0), 0)::DOUBLE * greatest(least(x * 40.0 + (user_id % 7) * 40, ph) - greatest(x * 40.0 - 50, 0), 0)::DOUBLE AS a FROM i)
SELECT user_id AS page_id, round(CASE WHEN max(ph) > 0 THEN least(sum(a) / (612 * max(ph)), 1) ELSE 0 END, 6) AS coverage FROM r GROUP BY user_id""",
    "needs_ocr": r"SELECT doc_id, len(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) < 40 AND (doc_id % 10) / 10 >= 0.30 AS wants FROM documents",
    "raster_guard": "SELECT doc_id, CASE WHEN floor(n_chars * 300 / 72)::BIGINT * floor(n_chars * 0.5 * 300 / 72)::BIGINT > 40000000 THEN 'ocr_page:too_many_pixels' END AS error FROM documents",
    "ocr_tsv_layout": f"""WITH {_WORDS}, l AS (SELECT doc, block, par, line, string_agg(word, ' ' ORDER BY i % 4, l, i) AS v, sum(conf) AS c, count(*) AS n FROM good WHERE conf >= 0 AND NOT broken GROUP BY ALL),
pp AS (SELECT doc, block, par, string_agg(v, chr(10) ORDER BY line) AS v, sum(c) AS c, sum(n) AS n FROM l GROUP BY ALL)
SELECT item_id AS doc, coalesce(x.text, '') AS text, mean_confidence, NULL::VARCHAR AS error_code FROM benchmark LEFT JOIN (SELECT doc, string_agg(v, chr(10) || chr(10) ORDER BY block, par) AS text, round(sum(c) / sum(n), 2) AS mean_confidence FROM pp GROUP BY doc) x ON doc = item_id""",
    "ocr_gap_heuristic": f"""WITH {_WORDS}, g AS (SELECT *, l - lag(l + 70) OVER (PARTITION BY doc, block, par, line ORDER BY l, i) AS gap FROM good WHERE conf >= 0),
m AS (SELECT *, coalesce(median(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY doc, block, par, line), 10) AS mid FROM g),
l AS (SELECT doc, min(i) AS first, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap >= greatest(2 * mid, 20) THEN ' | ' ELSE ' ' END || word, '' ORDER BY m.l, i) AS v FROM m GROUP BY doc, block, par, line)
SELECT item_id AS doc, coalesce(x.text, '') AS text FROM benchmark LEFT JOIN (SELECT doc, string_agg(v, chr(10) ORDER BY first) AS text FROM l GROUP BY doc) x ON doc = item_id""",
    "pdf_outcome_rules": """WITH r AS (SELECT doc_id // 4 AS document_id, (doc_id % 4 + 1) AS page_number, doc_id % 3 <> 1 AS tried, doc_id % 7 = 0 AS broken,
  CASE WHEN (doc_id // 4) % 5 = 0 THEN ' - ' ELSE text END AS native, CASE WHEN (doc_id // 4) % 10 = 0 THEN '?' ELSE 'word' END AS ocr FROM documents),
s AS (SELECT *, tried AND (broken OR ocr = '?') AS failed FROM r),
t AS (SELECT *, regexp_matches(CASE WHEN tried AND NOT failed THEN ocr ELSE native END, '[\\p{L}\\p{N}]') AS speaks FROM s)
SELECT document_id, CASE WHEN count(*) FILTER (tried) > 2 THEN 'ocr_limit_exceeded' WHEN count(*) FILTER (tried) > 0 AND NOT bool_or(speaks) THEN 'no_extractable_text' ELSE 'ok' END AS status,
  count(*) AS n_pages, count(*) FILTER (tried) AS ocr_pages, coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (failed), '') AS failed_pages FROM t GROUP BY document_id""",
    "pdf_scanned_pages": """WITH q AS (SELECT doc_id, doc_id // 4 AS f, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id)::INT AS page_number, (doc_id // 4) % 9 = 4 AS blank, (doc_id // 4) % 9 = 7 OR doc_id % 3 = 1 AS picture, text FROM documents),
r AS (SELECT f, page_number, CASE WHEN blank THEN doc_id % 4 <> 0 ELSE picture END AS scan, NOT blank AND NOT picture AND doc_id % 16 = 3 AS huge, CASE WHEN NOT blank THEN text WHEN doc_id % 4 = 0 THEN '- -' ELSE '' END AS body FROM q),
s AS (SELECT *, scan OR huge AS tried, huge OR (scan AND (body = '' OR body LIKE 'T%')) AS failed FROM r),
t AS (SELECT *, CASE WHEN tried AND failed THEN '' WHEN tried THEN 'read: ' || body ELSE body END AS content FROM s),
d AS (SELECT f, count(*) FILTER (tried) AS n, string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (failed) AS failed, bool_or(regexp_matches(content, '[\\p{L}\\p{N}]')) AS speaks FROM t GROUP BY f),
o AS (SELECT *, CASE WHEN n > 3 THEN 'ocr_limit_exceeded' WHEN n > 0 AND NOT speaks THEN 'no_extractable_text' END AS e FROM d)
SELECT '/in/' || f || '.pdf' AS document_id, page_number, md5(content) AS content, CASE WHEN tried AND NOT t.failed THEN 'ocr' ELSE 'native_text' END AS method, CASE WHEN n > 0 THEN coalesce(o.failed, '') END AS failed, CASE WHEN n > 0 THEN n::VARCHAR END AS tried, NULL::VARCHAR AS error_code FROM t JOIN o USING (f) WHERE e IS NULL
UNION ALL SELECT '/in/' || f || '.pdf', NULL, NULL, NULL, NULL, NULL, e FROM o WHERE e IS NOT NULL""",
}
