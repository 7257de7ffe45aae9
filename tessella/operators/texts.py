"""Text audit: counts of words, citations and markers, paragraphs, weighted value counts, table previews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What the audit looks for.
WORD = r"[\p{L}\p{N}_]+"
SQUARE = r"\[\d+(?:\s*[-,]\s*\d+)*\]"
AUTHOR_YEAR = r"\([A-Z][^()]{1,60},\s*20\d{2}\)"
TEMPLATE_MARKERS = ["contoh", "misalnya", "format baku", "universitas xyz", "azkia informasia", "deteksi sel kanker"]
XML_MARKERS = ["w:instrText", "<w:ins", "<w:del"]


def body(text) -> F.Column:
    """The paragraphs that aren't blank, joined."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != ""), "\n")


def count_of(text, marker: str) -> F.Column:
    """Non-overlapping occurrences of a string."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("long")


def word_counts(docs: DataFrame) -> DataFrame:
    t = body(F.col("text"))
    return docs.select("doc_id", F.regexp_count(t, F.lit(WORD)).cast("long").alias("n_words"), F.char_length(t).cast("long").alias("n_chars"))


def citations(docs: DataFrame) -> DataFrame:
    t = body(F.col("text"))
    return docs.select("doc_id", F.regexp_count(t, F.lit(SQUARE)).cast("long").alias("square"), F.regexp_count(t, F.lit(AUTHOR_YEAR)).cast("long").alias("author_year"))


def markers(docs: DataFrame, names: list[str]) -> DataFrame:
    """Occurrences of the markers in each case-folded text, summed."""
    t = F.lower("text")
    return docs.select("doc_id", sum((count_of(t, m) for m in names[1:]), count_of(t, names[0])).alias("n_markers"))


def paragraphs(docs: DataFrame, start: int, end: int, most: int = 1000) -> DataFrame:
    """Paragraphs [start, end) that aren't blank, trimmed and cut."""
    p = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "body"))
    p = p.where((F.col("paragraph") >= start) & (F.col("paragraph") < end)).withColumn("body", F.trim("body"))
    return p.where("body <> ''").select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.substring("body", 1, most).alias("body"))


def weighted_counts(rows: DataFrame, value: str, weight: str, k: int = 10) -> DataFrame:
    """The k values of greatest weight."""
    return rows.groupBy(value).agg(F.sum(weight).alias("weight")).orderBy(F.col("weight").desc(), value).limit(k)


def table_preview(rows: DataFrame, cells: list[str], order: str, group: str, most_rows: int = 12, most_chars: int = 250) -> DataFrame:
    """The first rows of each table, cells cut and joined."""
    from pyspark.sql import Window as W

    cut = [F.substring(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\n"), F.lit(" / ")), 1, most_chars) for c in cells]
    nth = F.row_number().over(W.partitionBy(group).orderBy(order))
    return rows.withColumn("row", nth).where(F.col("row") <= most_rows).select(group, F.col("row").cast("long").alias("row"), F.concat_ws(" | ", *cut).alias("line"))
