"""Corpus pipeline: language ID, SimHash near-dedup, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of ``documents``;
the last returns the packed pieces. A stage's result has to be written before the next stage is called, which deletes the
intermediate tables of the one before.

* ``language_id``: documents whose text has no language (``und``) or whose posterior is under one half go.
* ``near_dedup``: one row of each SimHash component stays, the one with the smallest doc_id; rows of different components
  stay apart even if they share an id or have none. Documents link by five words and a similarity of about 0.8
  (``simhash.near_texts``; README has figures).
* ``passage_dedup``: bytes under a 200-byte string that occurred before (in a document of smaller doc_id, or in the same
  one without overlap) are cut out, so that each passage stays once; a document of which nothing but white space remains
  goes. n_chars is that of the new text.
* ``mixture``: a document is returned as often as its source's target takes it; the one document on a source's border
  is cut to the words taken, joined by one space.
* ``packing``: pieces of at most 2,048 tokens with their place in a sequence.

Defined cases, in every stage: extra columns are dropped; an empty table gives an empty one of the same columns; very long
texts are handled whole. Null or letterless texts are ``und`` and go in the first stage; a later stage that still meets a
null text takes it as empty. Null lang or source: kept as they are (a null source is a source of its own). Null doc_id:
behind all others; each component of such rows keeps one. Repeated rows: one stays from the second stage on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid_ppm, mixing, packing, simhash, suffix_dedup
from tessella.llm.common import own_tables, release, shared_table
from tessella.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # SQL can't express the models and hashes of the stages

_made: list[tuple[str, str]] = []  # intermediate tables of the stage that ran last


def _stage(f: Callable) -> Callable:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _made)
        with own_tables() as own:
            out = f(spark, docs, sf_dir)
        _made.extend(own)
        return out

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:])


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = langid_ppm.predict(docs, langid_ppm.train(docs), keep=COLUMNS[1:])
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= 0.5)).select(*COLUMNS)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = shared_table(_rows(docs).withColumn("row", F.monotonically_increasing_id()), "rows", compression="zstd")  # written once, so a row keeps its number
    found = simhash.near_texts(docs, id_col="row").withColumnRenamed("doc_id", "row")
    content = F.xxhash64(F.struct("text", "lang", "source", "n_chars"))  # of rows that share an id the same one is chosen in every run
    ranked = docs.select("row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", content.alias("content"), "row").alias("rank"))
    kept = ranked.join(found, "row").groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.row")
    return docs.join(kept, "row", "left_semi").select(*COLUMNS)


@_stage
def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = suffix_dedup.repeats(_rows(docs), law="first", with_text=True, keep=("lang", "source"))
    return rest.where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


@_stage
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.drawn_documents(_rows(docs)).select(*COLUMNS)


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(docs, tokenizer_path()))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mixture", mixture), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
