"""Evaluation of retrieval and of text recognition as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import char_error_rate, strip, word_error_rate


def per_query(hits: DataFrame, expected: DataFrame, questions: DataFrame) -> DataFrame:
    """Measures of each question.

    hits: (query_id, rank, document_name); expected: (query_id, document_name); questions: (query_id,
    category). A question without expected documents is irrelevant: all its measures are 0, and it is
    rejected if nothing was returned.
    """
    wanted = expected.select("query_id", "document_name").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    marked = hits.join(wanted.withColumn("good", F.lit(True)), ["query_id", "document_name"], "left")
    found = marked.groupBy("query_id").agg(
        F.count("*").alias("n_returned"),
        F.count_if("good").alias("n_good"),
        F.count_distinct(F.when(F.col("good"), F.col("document_name"))).alias("n_documents"),
        F.min(F.when(F.col("good"), F.col("rank"))).alias("first_rank"),
    )
    rows = questions.join(sizes, "query_id", "left").join(found, "query_id", "left").fillna(0, ["n_expected", "n_returned", "n_good", "n_documents"])
    relevant = F.col("n_expected") > 0

    def measure(c: Column) -> Column:
        return F.when(relevant, F.coalesce(c.cast("double"), F.lit(0.0))).otherwise(0.0)

    return rows.select(
        "query_id",
        "category",
        relevant.alias("relevant"),
        F.col("n_returned").cast("long").alias("n_returned"),
        measure(F.col("n_good") > 0).alias("hit"),
        measure(F.col("n_documents") / F.nullif("n_expected", F.lit(0))).alias("recall"),
        measure(F.col("n_good") / F.nullif("n_returned", F.lit(0))).alias("precision"),
        measure(1 / F.col("first_rank")).alias("reciprocal_rank"),
        (F.col("n_returned") == 0).alias("rejected"),
    )


#: Words of a needle by which documents are searched for it, and needles too short for that, at most.
NEEDLE_WORDS, SHORT_NEEDLES = 3, 10_000


def containing(documents: DataFrame, needles: DataFrame) -> DataFrame:
    """(query_id, document_name) of the documents (document_name, text) that contain a needle (query_id, needle).

    A text that contains a needle has its inner words in turn (the outer ones may be parts of longer
    words). So a hash of three inner words leads to the documents worth a look, by joins on that hash
    and on the name; needles of fewer words are few, which is checked, and are broadcast.
    """
    n = NEEDLE_WORDS

    def words(c: str) -> Column:
        return F.filter(F.split(c, r"\s+"), lambda w: w != "")

    inner = needles.select("query_id", "needle", words("needle").alias("w"))
    long, short = inner.where(F.size("w") >= n + 2), inner.where((F.size("w") < n + 2) & (F.col("needle") != ""))
    asked = long.select("query_id", "needle", F.xxhash64(*[F.col("w")[i + 1] for i in range(n)]).alias("h"))
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(n)]))
    places = documents.select("document_name", words("text").alias("w")).where(F.size("w") >= n).select("document_name", F.explode(runs).alias("h"))
    met = places.join(asked.select("query_id", "h"), "h").select("document_name", "query_id").distinct()
    texts = documents.where("text is not null")
    found = met.join(texts, "document_name").join(asked.select("query_id", "needle"), "query_id").where(F.contains("text", F.col("needle"))).select("query_id", "document_name")
    few = short.limit(SHORT_NEEDLES + 1).count()
    if few > SHORT_NEEDLES:
        raise ValueError(f"more than {SHORT_NEEDLES} needles are shorter than {n + 2} words")
    if few:
        found = found.union(texts.join(F.broadcast(short), F.contains("text", F.col("needle"))).select("query_id", "document_name"))
    return found.distinct()


def _summary() -> list[Column]:
    relevant = F.col("relevant")

    def over_relevant(c: str) -> Column:
        return F.coalesce(F.avg(F.when(relevant, F.col(c))), F.lit(0.0))

    return [
        F.count("*").alias("n_queries"),
        F.count_if(relevant).alias("n_relevant"),
        over_relevant("hit").alias("hit_rate"),
        over_relevant("recall").alias("recall"),
        over_relevant("precision").alias("precision"),
        over_relevant("reciprocal_rank").alias("mrr"),
        F.coalesce(F.avg(F.when(~relevant, F.col("rejected").cast("double"))), F.lit(1.0)).alias("rejection_rate"),
        F.avg("n_returned").alias("avg_returned"),
    ]


def summary(measures: DataFrame) -> DataFrame:
    """Means over the relevant questions, and the share of the irrelevant that got nothing (1 if there are none)."""
    return measures.agg(*_summary())


def by_category(measures: DataFrame) -> DataFrame:
    return measures.groupBy("category").agg(*_summary())


def percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median, and the 95th percentile without interpolation: the value at place min(int(0.95 n), n - 1).

    Rows are first counted by distinct value, on the map side too, so a hot group shrinks to its
    distinct values before its places are summed up.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by).orderBy("v")
    placed = counts.withColumn("last", F.sum("c").over(order) - 1).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    first = F.col("last") - F.col("c") + 1

    def at(place: Column) -> Column:
        return F.max(F.when((first <= place) & (place <= F.col("last")), F.col("v")))

    n = F.col("n")
    low, high = F.floor((n - 1) / 2), F.floor(n / 2)
    return placed.groupBy(*by).agg(F.max("n").alias("n"), ((at(low) + at(high)) / 2).alias("median"), at(F.least(F.floor(n * 95 / 100), n - 1)).alias("p95"))


def timing(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, median, least and greatest, to two places."""
    v = F.col(value)
    return rows.groupBy(*by).agg(F.round(F.avg(v), 2).alias("mean"), F.round(F.median(v), 2).alias("median"), F.round(F.min(v), 2).alias("min"), F.round(F.max(v), 2).alias("max"))


def mode_comparison(summaries: DataFrame, measures: list[str], pairs: tuple[tuple[str, str], ...] = (("semantic_rerank", "semantic"), ("hybrid_rerank", "hybrid"))) -> DataFrame:
    """(mode, measure, value, overhead): each mode's measures, and what they are above the mode that it builds on."""
    long = summaries.select("mode", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("x")).select("mode", "x.*")
    base = F.create_map(*[F.lit(x) for p in pairs for x in p])
    other = long.select(F.col("mode").alias("base"), "measure", F.col("value").alias("base_value"))
    joined = long.withColumn("base", base[F.col("mode")]).join(other, ["base", "measure"], "left")
    return joined.select("mode", "measure", "value", (F.col("value") - F.col("base_value")).alias("overhead"))


def macro_error(pairs: DataFrame) -> DataFrame:
    """(reference, hypothesis) to the unweighted means of the character and the word error rates."""
    return pairs.agg(F.count("*").alias("n"), F.avg(char_error_rate("reference", "hypothesis")).alias("macro_cer"), F.avg(word_error_rate("reference", "hypothesis")).alias("macro_wer"))


def recognition_errors(documents: DataFrame) -> DataFrame:
    """(doc, n_pages, reference_chars, hypothesis_chars, cer, wer, page_cers) of (doc, reference, pages array<string>).

    The pages, joined by blank lines, are held against the whole reference. Where there are several,
    each is also held against the reference's part of the same number between blank lines; a page
    beyond those parts against nothing.
    """
    rows = documents.select("doc", F.coalesce("reference", F.lit("")).alias("reference"), F.transform(F.coalesce("pages", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit(""))).alias("pages"))
    rows = rows.withColumn("hypothesis", F.array_join("pages", "\n\n"))
    truth = F.filter(F.split("reference", "\n\n"), lambda p: strip(p) != "")
    # an array of pairs, not a join: a document's pages are in its row
    each = F.transform("pages", lambda p, i: F.struct(p.alias("p"), F.coalesce(F.get(truth, i), F.lit("")).alias("r")))
    paged = rows.where(F.size("pages") > 1).select("doc", F.posexplode(each).alias("i", "x")).groupBy("doc").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", F.round(char_error_rate(F.col("x.r"), F.col("x.p")), 4).alias("cer")))), lambda x: x["cer"]).alias("page_cers")
    )
    out = rows.select(
        "doc", F.size("pages").alias("n_pages"), F.length("reference").alias("reference_chars"), F.length("hypothesis").alias("hypothesis_chars"),
        char_error_rate("reference", "hypothesis").alias("cer"), word_error_rate("reference", "hypothesis").alias("wer"),
    )
    return out.join(paged, "doc", "left")


def token_presence(text: Column, tokens: list[str]) -> Column:
    """Share of the tokens that the text contains."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in tokens), F.lit(0)) / len(tokens)


def line_count(text: Column) -> Column:
    """Lines of a text that are not blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
