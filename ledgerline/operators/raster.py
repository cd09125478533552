"""Raster chain on cells (image, y, x, value): flatten, threshold, despeckle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import grids as H
from ledgerline.operators.series import closing_2d


def restore(cells: DataFrame, image: list[str], y: str, x: str, value: str, window: int = 101, speckle: int = 8, drop_border: bool = False) -> DataFrame:
    """Background by closing, division, one Otsu threshold per image, ink strictly below it, components larger than ``speckle``.

    Returns the runs that stay: image, y, a, z, comp, cells and the threshold.
    """
    flat = closing_2d(cells, y, x, value, window, "bg", image).withColumn("flat", F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(value) / F.greatest(F.col("bg"), F.lit(1.0)) * 255)))
    bins = flat.groupBy(*image, F.floor("flat").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    w, whole = Window.partitionBy(*image).orderBy("bin"), Window.partitionBy(*image)  # 256 rows an image
    h = bins.withColumn("p", F.col("n") / F.sum("n").over(whole)).withColumn("om", F.sum("p").over(w)).withColumn("mu", F.sum(F.col("p") * F.col("bin")).over(w)).withColumn("t", F.sum(F.col("p") * F.col("bin")).over(whole))
    span = F.col("om") * (1 - F.col("om"))
    h = h.withColumn("v", F.when(span > 1e-12, F.pow(F.col("t") * F.col("om") - F.col("mu"), F.lit(2)) / span).otherwise(0.0))
    cut = h.groupBy(*image).agg(F.max_by("bin", F.struct(F.round("v", 6), -F.col("bin"))).alias("threshold"))
    ink = flat.join(cut, image).where(F.col("flat") < F.col("threshold"))
    runs = H.label_runs(ink, image, y, x, corners=True)
    sizes = H.component_sizes(runs, image, y)
    if drop_border:
        edge = cells.groupBy(*image).agg(F.max(x).alias("_mx"), F.max(y).alias("_my"), F.min(x).alias("_nx"), F.min(y).alias("_ny"))
        sizes = sizes.join(edge, image).where("x0 > _nx and y0 > _ny and x1 <= _mx and y1 <= _my").drop("_mx", "_my", "_nx", "_ny")
    kept = sizes.where(F.col("cells") > speckle).select(*image, "comp", "cells")
    return runs.join(kept, [*image, "comp"]).join(cut, image).select(*image, y, "a", "z", "comp", "cells", "threshold")
