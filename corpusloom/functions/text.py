"""Text functions as Column expressions: they stay in the JVM and inside generated code."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 characters that count as white space, without and with the line feed.
BLANKS = r"\u0009\u000B-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACES = BLANKS + r"\u000A"
#: Characters of words.
WORD = r"[\p{L}\p{N}_]+"
#: Characters that cleaning deletes: NUL, byte order mark, zero-width space.
DELETED = "\u0000\ufeff\u200b"
QUERY_CHARS_MOST = 10_000

# The stop words of the keyword index, in the order of the alphabet.
STOP_WORDS = (
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "being", "below", "between", "both", "but", "by", "can", "d", "did", "do", "does", "doing", "don", "down", "during", "each", "few", "for",
    "from", "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in",
    "into", "is", "it", "its", "itself", "just", "ll", "m", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on",
    "once", "only", "or", "other", "our", "ours", "ourselves", "out", "over", "own", "re", "s", "same", "she", "should", "so", "some", "such",
    "t", "than", "that", "the", "their", "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to",
    "too", "under", "until", "up", "ve", "very", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will",
    "with", "you", "your", "yours", "yourself", "yourselves",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(text), rf"\A[{SPACES}]+|[{SPACES}]+\z", "")


def without_marks(text: Column | str) -> Column:
    return F.translate(_col(text), DELETED, "")


def clean_text(text: Column | str) -> Column:
    """Line ends unified, lines trimmed, blanks and empty lines folded; '' for a null text."""
    out = without_marks(F.coalesce(_col(text), F.lit("")))
    out = F.translate(F.regexp_replace(F.translate(out, "\u00a0", " "), "\r\n?", "\n"), "\t", " ")
    out = F.regexp_replace(out, rf"[{BLANKS}]*\n[{BLANKS}]*", "\n")
    out = strip(out)
    out = F.regexp_replace(out, rf"[{BLANKS}]{{2,}}", " ")
    return F.regexp_replace(out, r"\n{3,}", "\n\n")


def tokenize(text: Column | str, stop_words: tuple[str, ...] | None = STOP_WORDS) -> Column:
    """Words in lower case, in order and with repeats, without stop words."""
    out = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    if stop_words:
        out = F.filter(out, lambda w: ~w.isin(*stop_words))
    return out


def alnum_count(text: Column | str) -> Column:
    """Letters and digits in a text."""
    return F.length(F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"[^\p{L}\p{N}]", ""))


def query_error(text: Column | str) -> Column:
    """Why a question can't be searched for; null if it can. The raw length counts."""
    raw = _col(text)
    return (
        F.when(raw.isNull(), "invalid_query:missing")
        .when(F.length(raw) > QUERY_CHARS_MOST, "invalid_query:too_long")
        .when(strip(without_marks(raw)) == "", "invalid_query:empty")
    )


def question_error(text: Column | str) -> Column:
    """As query_error, for questions to a generator: the cleaned length counts."""
    cleaned = strip(without_marks(_col(text)))
    return (
        F.when(_col(text).isNull(), "invalid_query:missing")
        .when(cleaned == "", "invalid_query:empty")
        .when(F.length(cleaned) > QUERY_CHARS_MOST, "invalid_query:too_long")
    )


def semantic_query(text: Column | str) -> Column:
    """What the dense retriever embeds: the stripped question without NULs."""
    return strip(F.translate(_col(text), "\u0000", ""))


def keyword_query(text: Column | str) -> Column:
    """What the keyword retriever tokenises: also without byte order marks and zero-width spaces."""
    return strip(without_marks(_col(text)))


def fold_text(text: Column | str) -> Column:
    """Text for error rates: white space folded, case and punctuation kept. Expects composed characters."""
    return strip(F.regexp_replace(F.coalesce(_col(text), F.lit("")), rf"[{SPACES}]+", " "))


def char_error_rate(reference: Column | str, hypothesis: Column | str) -> Column:
    """Edit distance by the reference's length; for an empty reference 0, or 1 if something was read."""
    r, h = fold_text(reference), fold_text(hypothesis)
    return F.when(F.length(r) == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(r, h) / F.length(r))


#: Code points that stand for words: letters of their own, without the surrogates.
_CODES = (range(0x4E00, 0xD800), range(0xE000, 0x110000))
WORDS_MOST = sum(map(len, _CODES))


def word_codes(reference: Column, hypothesis: Column) -> Column:
    """struct<r,h,n>: both texts with each distinct word of the pair as one character, and the words of the first.

    A dictionary takes time in proportion to the words, in Arrow batches; expressions over arrays would
    search all words for each. Null codes for a pair of more than WORDS_MOST distinct words.
    """

    @F.pandas_udf("struct<r:string,h:string,n:int>")
    def run(references: pd.Series, hypotheses: pd.Series) -> pd.DataFrame:
        out = []
        for texts in zip(references, hypotheses, strict=True):
            sides = [[w for w in t.split(" ") if w] for t in texts]
            codes = {w: i for i, w in enumerate(dict.fromkeys(w for side in sides for w in side))}
            if len(codes) > WORDS_MOST:
                out.append((None, None, len(sides[0])))
                continue
            first = len(_CODES[0])
            out.append((*("".join(chr(_CODES[0][c] if (c := codes[w]) < first else _CODES[1][c - first]) for w in side) for side in sides), len(sides[0])))
        return pd.DataFrame(out, columns=["r", "h", "n"])

    return run(reference, hypothesis)


def word_error_rate(reference: Column | str, hypothesis: Column | str) -> Column:
    """As char_error_rate, over words: each distinct word of the pair becomes one character first."""
    coded = word_codes(fold_text(reference), fold_text(hypothesis))
    n = coded["n"]
    return F.when(n == 0, F.when(F.length(coded["h"]) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(coded["r"], coded["h"]) / n)


def normalize_text(text: Column | str) -> Column:
    """Composed characters (NFC), then fold_text. Spark has no such function, so Arrow batches carry it."""
    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in texts], dtype=object)

    return fold_text(composed(_col(text)))
