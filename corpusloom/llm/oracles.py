"""DuckDB SQL for those of the queries that SQL can express."""

from __future__ import annotations

from corpusloom.llm.quality_rules import RULES, STOP_WORDS, WINDOW


def _rule(top: str, bottom: str, least: int | None, most: int | None) -> str:
    parts = [f"{top} * 1000 >= {bottom} * {least}"] * (least is not None) + [f"{top} * 1000 <= {bottom} * {most}"] * (most is not None)
    return " AND ".join(parts)


def op4() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    failed = ", ".join(f"CASE WHEN NOT ({_rule(*r[1:])}) THEN '{r[0]}' END" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(words[i : i + {WINDOW - 1}], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n > 1),
cov AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
m AS (SELECT doc_id,
  len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  len(words)::BIGINT AS n_words,
  len(array_to_string(words, ''))::BIGINT AS word_chars,
  len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
  len(list_filter(lines, lambda x: x LIKE '%...' OR x LIKE '%…'))::BIGINT AS n_ellipsis_lines,
  len(list_filter(lines, lambda x: x LIKE '-%' OR x LIKE '*%' OR x LIKE '•%'))::BIGINT AS n_bullet_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  list_filter([{failed}], lambda x: x IS NOT NULL) AS failed_rules FROM m)
SELECT *, NOT base_failed AND len(failed_rules) = 0 AS kept FROM j"""


def op10(window: int = 50) -> str:
    return rf"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(words[i : i + {window - 1}], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(words) - {window - 2})) AS i FROM w WHERE len(words) >= {window})),
m AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY gram) AS first FROM g) WHERE first < coalesce(doc_id, 9223372036854775807)),
gone AS (SELECT DISTINCT r, i + j AS p FROM m, range({window}) t(j)),
kept AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.p) AS text, count(*) AS n
  FROM (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w) x LEFT JOIN gone ON gone.r = x.r AND gone.p = x.p WHERE gone.p IS NULL GROUP BY x.r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)"""


ORACLES: dict[str, str] = {"op4_quality_rules": op4(), "op10_substring_dedup": op10()}
