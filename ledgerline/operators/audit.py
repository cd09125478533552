"""Cell audits: unpivot, compare with witnesses, classify, adjudicate, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import compare


def cells(df: DataFrame, keys: list[str], fields: list[str], value: str = "value") -> DataFrame:
    """Unpivot: keys, field, value."""
    return df.select(*keys, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]).unpivot(keys, fields, "field", value)


def audit(dataset: DataFrame, witness_a: DataFrame, witness_b: DataFrame, keys: list[str], norm, alternatives) -> DataFrame:
    """Cells (keys, field, value) against two witnesses' cells: verdict_a, verdict_b and class.

    A cell is agreed when each verdict is agree or agree-uncertain (both may be uncertain).
    """
    on = [*keys, "field"]
    got = dataset.join(witness_a.withColumnRenamed("value", "read_a"), on, "left").join(witness_b.withColumnRenamed("value", "read_b"), on, "left")
    value = norm(F.col("field"), F.col("value"))

    def verdict(read):
        return compare(value, F.when(F.col(read).isNotNull(), norm(F.col("field"), F.col(read))), alternatives(F.col("field"), F.col(read)))

    got = got.withColumn("verdict_a", verdict("read_a")).withColumn("verdict_b", verdict("read_b"))
    fine = F.array(F.lit("agree"), F.lit("agree-uncertain"))
    agreed = F.size(F.array_except(F.array("verdict_a", "verdict_b"), fine)) == 0
    return got.withColumn("class", F.when(agreed, "agreed").otherwise("disagreement"))


def adjudicate(df: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Left join of decisions (key, resolution, reason) with the defaults uncertain and empty."""
    got = df.join(decisions, key, "left")
    return got.withColumn("resolution", F.coalesce("resolution", F.lit("uncertain"))).withColumn("reason", F.coalesce("reason", F.lit("")))


def label_audit(df: DataFrame, key: str, label: str, seen_a: DataFrame, seen_b: DataFrame, decisions: DataFrame) -> DataFrame:
    """Labels against two sets: blank agreed; in both and not adjudicated agreed; adjudicated disagreement; else illegible."""
    found = df.withColumn("_l", F.upper(label))
    for name, seen in (("in_a", seen_a), ("in_b", seen_b)):
        marks = seen.select(F.col(seen.columns[0]).alias("_l")).distinct().withColumn(name, F.lit(True))
        found = found.join(marks, "_l", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    found = found.join(decisions.select(key).distinct().withColumn("_d", F.lit(True)), key, "left")
    kind = F.when(F.coalesce(F.col(label), F.lit("")) == "", "agreed").when(F.col("in_a") & F.col("in_b") & F.col("_d").isNull(), "agreed").when(F.col("_d"), "disagreement").otherwise("chart-illegible")
    return found.withColumn("class", kind).drop("_l", "_d")


def reconcile(df: DataFrame, ours: str, theirs: str) -> DataFrame:
    """delta = ours - theirs (3 decimals) and pct of the unrounded delta (2 decimals); null when either side is."""
    delta = F.col(ours) - F.col(theirs)
    return df.withColumn("delta", F.round(delta, 3)).withColumn("pct", F.when(F.col(theirs) != 0, F.round(delta / F.col(theirs) * 100, 2)))


def verdicts(components: DataFrame, key: str) -> DataFrame:
    """Components (key, status, novel, undecided) -> one verdict: novel ones first, else all; undecided ones override."""
    n = lambda c: F.count_if(c)
    novel, yes, no = F.col("novel"), F.col("status") == "confirmed", F.col("status") == "refuted"
    g = components.groupBy(key).agg(
        n(novel).alias("novels"), n(F.lit(True)).alias("alls"), n(novel & yes).alias("novel_yes"), n(yes).alias("all_yes"),
        n(novel & no).alias("novel_no"), n(no).alias("all_no"), n(F.col("undecided") & novel).alias("novel_open"), n(F.col("undecided")).alias("all_open"),
    )
    pick = lambda a, b: F.when(F.col("novels") > 0, F.col(a)).otherwise(F.col(b))
    size, confirmed, refuted, open_ = pick("novels", "alls"), pick("novel_yes", "all_yes"), pick("novel_no", "all_no"), pick("novel_open", "all_open")
    v = F.when(open_ > 0, "undetermined").when(confirmed == size, "confirmed").when(confirmed > 0, "partially confirmed").when(refuted > 0, "refuted").otherwise("unfalsifiable")
    return g.select(key, v.alias("verdict"), F.when(F.col("novels") > 0, "novel").otherwise("period-standard").alias("novelty"))
