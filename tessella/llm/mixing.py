"""Mixing sources to target weights with a time-varying curriculum, in DataFrame functions only.

Targets: sources, ranked by code point (null last), weigh ``weights`` in turn and share all words; no target exceeds
``most`` times its source's words, and the excess is reshared by weight (a water level found by two running sums over
the source table, which has a row per source).

Draws: inside a source documents stand in an order fixed by the MD5 of their id. With T words to take from a source of
S words every document is taken T div S times, and the first T mod S words of the order once more, so a source's taken
words sum to its target rounded to a word; the one document on the border is taken in part.

Curriculum: over training time t in [0, 1] a source of weight class k is drawn at the rate 1 + tilt_k (2t - 1) times
its target. Its integral, t + tilt (t^2 - t), is the share of its words used up to t; inverted at a document's place in
its source's demand it gives the training position, and the documents are range-sorted by position. Time is each source's
own: at time t a source has used that share of its words, so what is drawn of all sources up to t follows their rates.

Running sums over a source go in two steps (4,096 hash ranges, then inside a range), so a hot source is no hot task.

Defined cases: very long texts: counted whole; ties of position: by id; null text or only white space: size 0, taken 0, no position; null source: a source of its own, ranked
last; all sizes 0: targets 0; repeated rows: drawn one by one; null doc_id: first in its source's order; empty table:
no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, shared_table

WORD = r"[^\x20\x09-\x0D]+"


def inverse(x: Column, tilt: Column) -> Column:
    """t with t + tilt (t^2 - t) = x, for x in [0, 1] and tilt in (-1, 1)."""
    root = (tilt - 1 + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x)) / (2 * tilt)
    return F.when(tilt == 0, x).otherwise(root)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), tilts=(-0.5, 0.0, 0.5), most: int = 3) -> DataFrame:
    """sizes(source, size) to (skey, source_size, target, quota, tilt): a row per source."""
    per = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    nth = rank % len(weights) + 1
    per = per.withColumn("nth", nth).withColumn("w", F.element_at(F.array(*map(F.lit, weights)), F.col("nth")).cast("double")).withColumn("tilt", F.element_at(F.array(*map(F.lit, map(float, tilts))), F.col("nth")))
    cap = F.lit(most) * F.col("source_size")
    by = W.orderBy(cap / F.col("w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(W.partitionBy())
    capped = F.coalesce(F.sum(cap).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_w = F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    per = per.withColumn("cap", cap.cast("double")).withColumn("level", (total - capped) / open_w)
    level = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("level").alias("v")))).over(W.partitionBy()).getField("v")
    per = per.withColumn("target", F.least(F.col("cap"), level * F.col("w")))
    return per.select("skey", "source_size", "target", F.round("target").cast("long").alias("quota"), "tilt")


def draws(docs: DataFrame, weights=(5, 2, 1), tilts=(-0.5, 0.0, 0.5), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, quota, tilt, at, taken[, row]) of every row; at: words of the source before it.

    row_col: a number of each row, which goes along; rows alike in id and size then stand in the order of their texts' hashes.
    """
    n = partitions(docs.sparkSession)
    row = [F.col(row_col).alias("row")] if row_col else []
    doc = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"), *row)
    sizes = doc.select("doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")).alias("key"), *([F.xxhash64("text").alias("tie"), "row"] if row else []))
    sizes = shared_table(sizes.withColumn("part", F.substring("key", 1, 3)), "words")
    per = shared_table(source_targets(sizes, weights, tilts, most), "targets")
    part = sizes.groupBy("skey", "part").agg(F.sum("size").alias("words"))
    base = part.select("skey", "part", F.coalesce(F.sum("words").over(W.partitionBy("skey").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = base.join(per, "skey")
    dealt = sizes.repartition(n, "skey", "part").join(base.repartition(n, "skey", "part").hint("merge"), ["skey", "part"])
    inside = W.partitionBy("skey", "part").orderBy("key", "doc_id", "size", *(["tie", "row"] if row else [])).rowsBetween(W.unboundedPreceding, 0)
    at = F.col("base") + F.sum("size").over(inside) - F.col("size")
    drawn = dealt.withColumn("at", at).withColumn("laps", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)))
    extra = F.col("quota") - F.col("laps") * F.col("source_size")
    taken = F.col("laps") * F.col("size") + F.greatest(F.lit(0), F.least("size", extra - F.col("at")))
    return drawn.select("doc_id", "size", "source_size", "target", "quota", "tilt", "at", taken.alias("taken"), *(["row"] if row else []))


def position(words_before: Column) -> Column:
    """Training position of the draw that has so many of its source's taken words before it."""
    share = words_before.cast("double") / F.col("quota").cast("double")
    return F.round(inverse(F.least(share, F.lit(1.0)), F.col("tilt")), 9)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position) of every row, sorted by (first) training position."""
    drawn = draws(docs, **options).withColumn("position", F.when(F.col("taken") > 0, position(F.col("at"))))
    return drawn.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", "doc_id")


def drawn_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: ``docs`` (doc_id unique, repeated or null) with a row per draw and its ``position``, sorted by it from partition to partition.

    A draw in part keeps a document's first words, joined by one space, and n_chars follows if there is such a column.
    A column ``position`` of ``docs`` is replaced. Rows are numbered in a table written once, and joined by that number.
    """
    own = [c for c in docs.columns if c != "position"]
    docs = shared_table(docs.select(*own, F.monotonically_increasing_id().alias("_mix_row")), "rows", compression="zstd")
    left = F.col("taken") - F.col("lap") * F.col("size")
    drawn = draws(docs, row_col="_mix_row", **options).where("taken > 0").withColumn("lap", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size"))))
    drawn = drawn.select(F.col("row").alias("_mix_row"), F.struct(F.least("size", left).cast("int").alias("words"), (F.col("size") > left).alias("cut"), position(F.col("at") + F.col("lap") * F.col("source_size")).alias("position")).alias("_mix"))
    n = partitions(docs.sparkSession)
    drawn = shared_table(drawn.repartitionByRange(n, "_mix.position", "_mix_row").withColumn("_mix_task", F.spark_partition_id()), "draws")  # ranges are cut without the texts
    out = docs.join(drawn, "_mix_row").repartitionById(n, F.col("_mix_task")).sortWithinPartitions("_mix.position", "_mix_row")
    start = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_mix.words")), " ")
    out = out.withColumn("text", F.when(F.col("_mix.cut"), start).otherwise(F.col("text")))
    if "n_chars" in own:
        out = out.withColumn("n_chars", F.when(F.col("_mix.cut"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*own, F.col("_mix.position").alias("position"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(doc_id::VARCHAR) AS key
  FROM documents),
p AS (SELECT skey, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS nth FROM p),
c AS (SELECT *, CASE nth WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
             CASE nth WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS tilt,
             (3 * source_size)::DOUBLE AS cap FROM w),
l AS (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level
      FROM c),
t AS (SELECT *, least(cap, w * (SELECT arg_min(level, cap / w) FROM l WHERE cap / w >= level)) AS target FROM l),
q AS (SELECT *, round(target)::BIGINT AS quota FROM t),
a AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.quota, q.tilt,
             (sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS place
      FROM d JOIN q USING (skey)),
g AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS laps FROM a),
k AS (SELECT *, (laps * size + greatest(0, least(size, quota - laps * source_size - place)))::BIGINT AS taken,
             least(place::DOUBLE / nullif(quota, 0)::DOUBLE, 1.0::DOUBLE) AS x FROM g)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN tilt = 0 THEN x
            ELSE (tilt - 1 + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * x)) / (2 * tilt) END, 9) END AS position
FROM k
"""
