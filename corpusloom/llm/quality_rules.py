"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every measure is an array or string expression over the text of one row, so the plan is a scan and
projections: no shuffle, no Python, and nothing that grows beyond one document.

Defined results: a null or blank text has no words and fails; a null id is kept as null; repeated
rows are judged one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import words_of

#: Width of the windows whose repetition counts.
WINDOW = 8

#: Frequent function words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "this", "are", "by", "from", "or",
    "der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "avec",
    "el", "y", "los", "del", "se", "las", "por", "con", "para", "su", "al", "es", "una", "lo", "como", "más", "pero", "sus", "no", "o",
)

#: (rule, numerator, denominator, least share, greatest share), shares in thousandths; None: no bound.
#: A rule fails if 1000 * numerator falls outside share * denominator.
RULES = (
    ("mean_word_chars", "word_chars", "n_words", 2000, 16000),
    ("symbol_ratio", "n_symbols", "n_words", None, 100),
    ("stop_word_ratio", "n_stop_words", "n_words", 20, None),
    ("dup_line_ratio", "n_dup_lines", "n_lines", None, 400),
    ("ellipsis_line_ratio", "n_ellipsis_lines", "n_lines", None, 300),
    ("bullet_line_ratio", "n_bullet_lines", "n_lines", None, 900),
)


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """The counts that the rules compare, beside `df`'s columns.

    Columns are made in steps, so that an array that several expressions read is computed once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    held = [F.col(f"`{c}`") for c in df.columns]
    out = df.select(
        *held,
        words_of(F.col(text)).alias("_words"),
        F.expr(f"filter(split(coalesce(`{text}`, ''), '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("_lines"),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    in_list = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.concat_ws("", "_words")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_stop_words": F.expr(f"size(filter(_words, w -> lower(w) in ({in_list})))").cast("long"),
            "n_ellipsis_lines": F.expr("size(filter(_lines, x -> x like '%...' or x like '%…'))").cast("long"),
            "n_bullet_lines": F.expr("size(filter(_lines, x -> x like '-%' or x like '*%' or x like '•%'))").cast("long"),
            "_grams": F.expr(
                f"if(size(_words) < {WINDOW}, cast(array() as array<bigint>), "
                f"transform(sequence(1, size(_words) - {WINDOW - 1}), i -> xxhash64(slice(_words, i, {WINDOW}))))"
            ),
        }
    )
    # Only texts that repeat a window pay for sorting their windows by content and place.
    out = out.withColumn(
        "_sorted",
        F.expr(
            "if(size(array_distinct(_grams)) < size(_grams), "
            "array_sort(transform(_grams, (x, i) -> struct(x as h, i as i))), cast(array() as array<struct<h:bigint,i:int>>))"
        ),
    )
    out = out.withColumn(
        "_starts",
        F.expr("array_sort(transform(filter(_sorted, (e, k) -> get(_sorted, k - 1).h <=> e.h or get(_sorted, k + 1).h <=> e.h), e -> e.i))"),
    )
    covered = F.expr(
        f"aggregate(transform(_starts, (x, k) -> least({WINDOW}, coalesce(get(_starts, k + 1) - x, {WINDOW}))), 0L, (a, b) -> a + b)"
    )
    return out.withColumn("n_repeat_words", covered).drop("_words", "_lines", "_grams", "_sorted", "_starts")


def rule_column(top: str, bottom: str, least: int | None, most: int | None) -> Column:
    """True where the share top/bottom, in thousandths, keeps within the bounds."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (F.col(top) * 1000 >= F.col(bottom) * least)
    if most is not None:
        ok = ok & (F.col(top) * 1000 <= F.col(bottom) * most)
    return ok


def judge(measured: DataFrame, rules: tuple = RULES) -> DataFrame:
    """The whole table of rules as one projection: base_failed, failed_rules and kept."""
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    names = F.array_compact(F.array(*[F.when(~rule_column(*bounds), F.lit(name)) for name, *bounds in rules]))
    return measured.select("*", failed.alias("base_failed"), names.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def quality_rules(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Measures and verdict of each row of `docs` (doc_id, text)."""
    return judge(measure(docs.select("doc_id", "text")), rules).drop("text")
