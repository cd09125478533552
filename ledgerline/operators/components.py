"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.durable import stored


def _each(edges: DataFrame, *ways: tuple[Column, Column]) -> DataFrame:
    """A row (a, b) for every way that an edge gives, in one pass over the edges; loops go."""
    rows = edges.select(F.explode(F.array(*[F.struct(x.alias("a"), y.alias("b")) for x, y in ways])).alias("_e")).select("_e.a", "_e.b")
    return rows.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for the ends of edges (a, b): comp is the least id reachable. Every round is written to the shared folder.

    The edges are written before anything reads them, so a plan behind them that depends on the
    order of its rows runs once. A first step points every node, and its other smaller neighbours,
    at the least of them: a group that many stars cover keeps about one edge a member.
    """
    a, b = F.col("a"), F.col("b")
    edges = stored(_each(edges, (F.least(a, b), F.greatest(a, b))))
    edges = edges.join(edges.groupBy("b").agg(F.min("a").alias("m")), "b")
    edges = stored(_each(edges, (F.col("m"), b), (F.col("m"), a)))
    both = stored(_each(edges, (a, b), (b, a)).toDF("id", "near"))
    labels = stored(both.groupBy("id").agg(F.least(F.col("id"), F.min("near")).alias("comp")))
    while True:
        near = both.join(labels.toDF("near", "near_comp"), "near").groupBy("id").agg(F.min("near_comp").alias("least"))
        step = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "least").alias("comp"))
        roots = step.select(F.col("id").alias("root"), F.col("comp").alias("jump"))
        step = stored(step.join(roots, step["comp"] == roots["root"]).select("id", "old", F.least("comp", "jump").alias("comp")))
        labels = step.select("id", "comp")
        if not step.where("old != comp").limit(1).count():
            return labels
