"""Exact order statistics without a sort of a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.durable import stored

CELLS = 1024


def values_at_ranks(df: DataFrame, group: str, value: str, ranks: dict) -> DataFrame:
    """group and a column for each of ``ranks``: the value at ``rank(n)`` (from 0) among the group's n values in order.

    Equal values are counted first, then counts are summed in cells of the group's range: only the cells that hold a
    wanted rank are sorted. Null values do not count; a group without any is absent. The counts are written once, so
    what reads them sees one result of whatever plan is behind them.
    """
    counts = stored(df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c")))
    span = counts.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_c").alias("_n"))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (CELLS - 1))).otherwise(F.lit(0))
    counts = counts.join(span, group).withColumn("_cell", cell)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("long").alias("at")) for name, rank in ranks.items()])).alias("_w")
    cells = counts.groupBy(group, "_cell", "_n").agg(F.sum("_c").alias("_m"))
    cells = cells.withColumn("_before", F.sum("_m").over(Window.partitionBy(group).orderBy("_cell")) - F.col("_m"))  # CELLS rows a group
    cells = cells.select(group, "_cell", "_before", "_m", wanted).where((F.col("_w.at") >= F.col("_before")) & (F.col("_w.at") < F.col("_before") + F.col("_m")))
    cells = cells.groupBy(group, "_cell", "_before").agg(F.collect_list("_w").alias("_ws"))
    inside = counts.join(cells, [group, "_cell"]).withColumn("_end", F.sum("_c").over(Window.partitionBy(group, "_cell").orderBy(value)) + F.col("_before"))
    hit = inside.select(group, value, "_end", "_c", F.explode("_ws").alias("_w")).where((F.col("_w.at") < F.col("_end")) & (F.col("_w.at") >= F.col("_end") - F.col("_c")))
    return hit.groupBy(group).agg(*[F.max(F.when(F.col("_w.name") == name, F.col(value))).alias(name) for name in ranks])


def quantiles(df: DataFrame, group: str, value: str, shares: dict, upper: dict | None = None) -> DataFrame:
    """group and a column for each share: the value there, interpolated between neighbours; ``upper``: values at n * share, whole."""
    at = lambda q: lambda n: (n - 1) * q
    ranks = {f"_{name}_{side}": (lambda n, q=q, f=f: f(at(q)(n))) for name, q in shares.items() for side, f in (("lo", F.floor), ("hi", F.ceil))}
    ranks |= {name: (lambda n, q=q: F.floor(n * q)) for name, q in (upper or {}).items()}
    sizes = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
    got = values_at_ranks(df, group, value, ranks).join(sizes, group)
    part = lambda q: at(q)(F.col("_n")) - F.floor(at(q)(F.col("_n")))
    between = [(F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * part(q)).alias(name) for name, q in shares.items()]
    return got.select(group, *between, *(upper or {}))
