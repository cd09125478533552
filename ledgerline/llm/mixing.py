"""Operator 3: mixing sources to target weights by capped water-filling (DataFrame functions only).

Sources are clamped at ``max_epochs`` times their size; the excess goes to the others in
proportion to their weights until none is above its clamp. The fixed point is a water
level: source s gets min(max_epochs * size_s, level * weight_s), and sorting sources by
clamp / weight makes the level one running sum over the table of sources.

Documents then give whole repetitions, plus one more for a seeded sample: documents of a
source are ordered by md5(seed, id) and taken until the remainder is used up; the document
at the boundary gives part of its words, so a source's words equal its rounded target. The
running sum over a source is taken in two levels (md5 prefix buckets, then inside a bucket),
so no task holds a whole source.

Defined results: null text has size 0; a null source is a source of its own, last in order;
equal ids share one md5 and are ordered by size; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import WORD, n_words, stored, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"


def water_fill(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(skey, source_size) -> plus target. Weights repeat over the sources in order of skey."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy("null_key", "skey")) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("clamp", F.col("source_size") * max_epochs)
    order = Window.orderBy(F.col("clamp") / F.col("weight"), "null_key", "skey")
    whole = Window.partitionBy()
    s = s.withColumn("clamped_before", F.coalesce(F.sum("clamp").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.col("clamped_before")) / F.col("weight_left"))
    s = s.withColumn("level", F.max("level").over(whole))  # rises while sources are clamped, then falls
    return s.withColumn("target", F.least(F.col("clamp").cast("double"), F.col("level") * F.col("weight"))).select("null_key", "skey", "source_size", "target")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repetitions counted)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("null_key"), F.coalesce(F.col(source_col), F.lit("")).alias("skey"), n_words(F.col(text_col)).alias("size"))
    base = base.withColumn("h", F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    base = stored(base.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 3), 16, 10).cast("int") / 4).cast("int")))
    key = ["null_key", "skey"]
    sums = base.groupBy(*key, "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = water_fill(sums.groupBy(*key).agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    upto = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("bucket_size").over(upto), F.lit(0))).join(targets, key)
    inside = Window.partitionBy(*key, "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, [*key, "bucket"])
    total = F.round("target").cast("long")
    rows = rows.withColumn("times", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
    rest = total - F.col("times") * F.col("source_size") - F.col("before") - F.col("inside")
    taken = F.col("times") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as it is taken; the last copy may be a part, which keeps the
    first words joined by one space. Rows that share id and size share what they take, in order of a hash of
    the text: evenly, and what is left over a word each. Documents without words are kept once."""
    taken = mix(docs, **options).groupBy("doc_id", "size").agg(F.sum("taken").alias("_sum"), F.count("*").alias("_n"))
    taken = taken.select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), "_sum", "_n")
    cols = docs.columns
    sized = docs.withColumn("_words", n_words(F.col("text")))
    got = sized.join(taken, sized["doc_id"].eqNullSafe(taken["_id"]) & (F.col("_words") == F.col("_size")))
    place = F.row_number().over(Window.partitionBy("_id", "_size").orderBy(F.xxhash64("text")))
    got = got.withColumn("_taken", F.expr("_sum div _n") + F.when(place <= F.col("_sum") % F.col("_n"), 1).otherwise(0))
    whole = F.when(F.col("_words") > 0, F.expr("_taken div _words")).otherwise(F.lit(1)).cast("int")
    part = F.when(F.col("_words") > 0, F.col("_taken") % F.col("_words")).otherwise(F.lit(0)).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.filter(F.array(part), lambda x: x > 0))
    got = got.withColumn("_part", F.explode(copies))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_part")), " ")
    got = got.withColumn("text", F.when(F.col("_part") > 0, cut).otherwise(F.col("text")))
    if "n_chars" in cols:
        got = got.withColumn("n_chars", F.when(F.col("_part") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return got.select(*cols)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
        FROM base GROUP BY source),
lv AS (SELECT *, 3 * source_size AS clamp,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o1, 0))::DOUBLE / sum(weight) OVER o2 AS level
       FROM src WINDOW o1 AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                       o2 AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
tg AS (SELECT source, source_size, least(clamp::DOUBLE, max(level) OVER () * weight) AS target FROM lv),
cum AS (SELECT b.doc_id, b.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS tt,
          coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.doc_id, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM base b JOIN tg t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (tt // source_size) * size
       + greatest(0, least(size, tt - (tt // source_size) * source_size - before)) END AS BIGINT) AS taken
FROM cum
"""

QUERIES = {"op3_mixing": op3_mixing}
SQL = {"op3_mixing": OP3_SQL}
