"""A small set of documents and questions with known answers, for comparing retrieval modes by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: (document_id, doc_ord, document_name, source_type, page_number, content)
PAGES = (
    ("tides", 1, "tides.pdf", "pdf", 1, "Tides are the rise and fall of the sea. The pull of the moon and, to a lesser part, of the sun raises the water on both sides of the globe, and most coasts see two high waters a day."),
    ("tides", 1, "tides.pdf", "pdf", 2, "When sun and moon stand in line, at new and full moon, the range grows to a spring tide. At the quarters they work against each other, and the range shrinks to a neap tide. Gauge TG-41 records the level every six minutes."),
    ("tides", 1, "tides.pdf", "pdf", 3, "Harbours publish tide tables so that ships with a deep draught can plan when to cross a shallow bar."),
    ("bread", 2, "bread.pdf", "pdf", 1, "Sourdough is raised by wild yeast and lactic bacteria kept in a starter of flour and water. The starter is fed daily. Recipe card BR-7 asks for 65 percent water by weight of flour. Bakers in harbour towns once sold hard ship's bread that kept for a year at sea."),
    ("glass", 3, "glass.pdf", "pdf", 1, "Glass is sand, soda and lime melted at about 1500 degrees and cooled too fast for crystals to grow. Sheet made by the float process spreads on a bath of molten tin, which leaves both faces flat. Standard GL-572 limits bubbles in window sheet."),
)
#: (query_id, category, query, names of the documents that answer it)
QUESTIONS = (
    (1, "meaning", "Why does the ocean go up and down along a shore?", ("tides.pdf",)),
    (2, "meaning", "What makes a loaf rise if no packaged yeast is added?", ("bread.pdf",)),
    (3, "meaning", "How do makers get window panes with even surfaces?", ("glass.pdf",)),
    (4, "words", "gauge TG-41", ("tides.pdf",)),
    (5, "words", "recipe card BR-7 water", ("bread.pdf",)),
    (6, "words", "standard GL-572 bubbles", ("glass.pdf",)),
    (7, "other words", "smaller difference between high and low water at half moon", ("tides.pdf",)),
    (8, "other words", "melted sand that solidifies without crystals", ("glass.pdf",)),
    (9, "several documents", "What did harbours and the bakers near them provide for ships?", ("tides.pdf", "bread.pdf")),
    (10, "unrelated", "Who won the chess championship?", ()),
    (11, "unrelated", "quarterly revenue guidance for semiconductors", ()),
    (12, "unrelated", "symptoms of vitamin deficiency", ()),
)


def sample_pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PAGES), "document_id string, doc_ord bigint, document_name string, source_type string, page_number int, content string")


def sample_questions(spark: SparkSession) -> DataFrame:
    """(query_id, category, query, expected)."""
    return spark.createDataFrame([(*q[:3], list(q[3])) for q in QUESTIONS], "query_id bigint, category string, query string, expected array<string>")
