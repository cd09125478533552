"""Catalog: points, grids, components and rasters, over embeddings and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import greedy as G
from ledgerline.operators import grids as H
from ledgerline.operators import joins as J
from ledgerline.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_XY = "WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


def _xy(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


def _angle(x, y):
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


@query(_XY + """
, a AS (SELECT vec_id, degrees(atan2(y,x)) - floor(degrees(atan2(y,x))/360)*360 AS t FROM p), l AS (SELECT * FROM a WHERE vec_id%2=0), r AS (SELECT vec_id AS other_id, t AS u FROM a WHERE vec_id%2=1)
SELECT vec_id, CAST(count(*) AS BIGINT) AS n, min(other_id) AS first_other FROM l JOIN r ON abs((t-u+180)-floor((t-u+180)/360)*360-180)<=2 GROUP BY 1
""")
def wrapped_band_join(spark, d):
    a = _xy(spark, d).select("vec_id", _angle(F.col("x"), F.col("y")).alias("t"))
    left, right = a.where("vec_id % 2 = 0"), a.where("vec_id % 2 = 1").toDF("other_id", "u")
    return J.wrapped_band_join(left, "t", right, "u", 2.0).groupBy("vec_id").agg(F.count("*").alias("n"), F.min("other_id").alias("first_other"))


@query(_XY + """
, m AS (SELECT *, avg(x) OVER (PARTITION BY label) AS mx, avg(y) OVER (PARTITION BY label) AS my FROM p), c AS (SELECT *, x-mx AS u, y-my AS v FROM m),
s AS (SELECT label, count(*) AS n, min(mx) AS mx, min(my) AS my, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*(u*u+v*v)) AS uq, sum(v*(u*u+v*v)) AS vq FROM c GROUP BY 1),
f AS (SELECT *, (uq*vv-vq*uv)/(2*(uu*vv-uv*uv)) AS a, (vq*uu-uq*uv)/(2*(uu*vv-uv*uv)) AS b FROM s)
SELECT label, CAST(n AS BIGINT) AS n, round(mx+a,5) AS cx, round(my+b,5) AS cy, round(sqrt(a*a+b*b+(uu+vv)/n),5) AS r FROM f
""")
def circle_fit(spark, d):
    return H.circle_fit(_xy(spark, d), ["label"], "x", "y").select("label", "n", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "r")])


def _fit_sql(rounds: int, tolerance: float) -> str:
    """Round after round: a fit of the points that the round before keeps."""
    out, src = _XY, "p"
    for k in range(rounds):
        out += f"""
, m{k} AS (SELECT label, avg(x) AS mx, avg(y) AS my FROM {src} GROUP BY 1), c{k} AS (SELECT label, mx, my, x-mx AS u, y-my AS v FROM {src} JOIN m{k} USING (label)),
s{k} AS (SELECT label, count(*) AS n, min(mx) AS mx, min(my) AS my, sum(u*u) AS uu, sum(u*v) AS uv, sum(v*v) AS vv, sum(u*(u*u+v*v)) AS uq, sum(v*(u*u+v*v)) AS vq FROM c{k} GROUP BY 1),
d{k} AS (SELECT *, (uq*vv-vq*uv)/(2*(uu*vv-uv*uv)) AS a, (vq*uu-uq*uv)/(2*(uu*vv-uv*uv)) AS b FROM s{k} WHERE uu*vv-uv*uv<>0),
f{k} AS (SELECT label, n, mx+a AS cx, my+b AS cy, sqrt(a*a+b*b+(uu+vv)/n) AS r FROM d{k}), t{k} AS (SELECT p.label, x, y FROM p JOIN f{k} USING (label) WHERE abs(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))-r)<{tolerance})"""
        src = f"t{k}"
    return out + f" SELECT label, CAST(n AS BIGINT) AS n, round(cx,5)+0 AS cx, round(cy,5)+0 AS cy, round(r,5) AS r FROM f{rounds - 1}"


@query(_fit_sql(6, 0.15))
def trimmed_fit(spark, d):
    fit = H.trimmed_circle_fit(_xy(spark, d), ["label"], "x", "y", 0.15)
    return fit.select("label", "n", (F.round("cx", 5) + 0).alias("cx"), (F.round("cy", 5) + 0).alias("cy"), F.round("r", 5).alias("r"))


@query(_XY + """
SELECT CAST(floor(sqrt(x*x+y*y)/0.05) AS BIGINT) AS r_bin, CAST(floor((degrees(atan2(y,x))-floor(degrees(atan2(y,x))/360)*360)/30) AS BIGINT) AS t_bin, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1,2
""")
def polar_bins(spark, d):
    x, y = F.col("x"), F.col("y")
    return _xy(spark, d).groupBy(F.floor(F.sqrt(x * x + y * y) / 0.05).cast("long").alias("r_bin"), F.floor(_angle(x, y) / 30).cast("long").alias("t_bin")).agg(F.count("*").alias("n"))


@query(_XY + """
, b AS (SELECT CAST(floor(sqrt(x*x+y*y)/0.1) AS BIGINT) AS r_bin, CAST(floor((degrees(atan2(y,x))-floor(degrees(atan2(y,x))/360)*360)/0.5) AS BIGINT) AS t_bin, x FROM p)
SELECT r_bin, round(avg(x),6) AS mean_x, round(count_if(x>0.05)/CAST(count(*) AS DOUBLE),6) AS occupancy, round(count(DISTINCT t_bin)/720.0,6) AS coverage FROM b GROUP BY 1
""")
def profile_occupancy(spark, d):
    x, y = F.col("x"), F.col("y")
    b = _xy(spark, d).select(F.floor(F.sqrt(x * x + y * y) / 0.1).cast("long").alias("r_bin"), F.floor(_angle(x, y) / 0.5).alias("t_bin"), "x")
    g = b.groupBy("r_bin").agg(F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.count_if(F.col("x") > 0.05) / F.count("*"), 6).alias("occupancy"), F.round(F.count_distinct("t_bin") / 720, 6).alias("coverage"))
    return g


#: A sparse grid of 2000 x 4000 cells.
_GRID = "WITH RECURSIVE g AS (SELECT DISTINCT CAST((l_orderkey*7+l_linenumber)%2000 AS BIGINT) AS y, CAST((l_partkey*31+l_suppkey*17)%4000 AS BIGINT) AS x FROM lineitem)"


def _grid(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 2000).cast("long").alias("y"), ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % 4000).cast("long").alias("x")).distinct()


_COMPONENTS = _GRID + """
, id AS MATERIALIZED (SELECT y, x, y*4000+x AS id FROM g), o AS (SELECT unnest([-1,0,1]) AS d), near AS MATERIALIZED (SELECT id, y+i.d AS y, x+j.d AS x FROM id, o i, o j),
e AS MATERIALIZED (SELECT n.id AS a, b.id AS b FROM near n JOIN id b ON b.y=n.y AND b.x=n.x WHERE n.id<>b.id),
w AS (SELECT id, id AS c FROM id UNION SELECT e.b, w.c FROM w JOIN e ON e.a=w.id), l AS (SELECT id, min(c) AS comp FROM w GROUP BY 1),
z AS (SELECT comp, id//4000 AS y, id%4000 AS x FROM l), s AS (SELECT comp, CAST(count(*) AS BIGINT) AS cells, CAST(min(x) AS BIGINT) AS x0, CAST(min(y) AS BIGINT) AS y0, CAST(max(x)+1 AS BIGINT) AS x1, CAST(max(y)+1 AS BIGINT) AS y1, round(avg(x),6) AS cx, round(avg(y),6) AS cy FROM z GROUP BY 1)
"""


def _labelled(spark, d):
    return H.component_sizes(H.label_runs(_grid(spark, d), [], "y", "x"), [], "y")


@query(_COMPONENTS + "SELECT cells, CAST(count(*) AS BIGINT) AS components FROM s GROUP BY 1")
def runs_and_components(spark, d):
    return _labelled(spark, d).groupBy("cells").agg(F.count("*").alias("components"))


@query(_COMPONENTS + "SELECT cells, x0, y0, x1, y1, cx, cy, CAST(row_number() OVER (PARTITION BY y0//5 ORDER BY y0, x0, cx, cy) AS BIGINT) AS place FROM s WHERE cells>=2 AND x1-x0<=20")
def component_extents(spark, d):
    from pyspark.sql import Window

    s = _labelled(spark, d).where("cells >= 2 and x1 - x0 <= 20").withColumn("cx", F.round("cx", 6)).withColumn("cy", F.round("cy", 6))
    w = Window.partitionBy(F.expr("y0 div 5")).orderBy("y0", "x0", "cx", "cy")
    return s.select("cells", "x0", "y0", "x1", "y1", "cx", "cy", F.row_number().over(w).cast("long").alias("place"))


@query(_COMPONENTS + ", big AS (SELECT comp FROM s WHERE cells>=3) SELECT z.y, z.x, CAST(s.cells AS BIGINT) AS cells FROM z JOIN big USING (comp) JOIN s USING (comp)")
def structural_mask(spark, d):
    """Cells of the components of three cells or more."""
    runs = H.label_runs(_grid(spark, d), [], "y", "x")
    big = H.component_sizes(runs, [], "y").where("cells >= 3").select("comp", "cells")
    return runs.join(big, "comp").select("y", F.explode(F.sequence("a", F.col("z") - 1)).alias("x"), "cells")


@query(_GRID + """
, o AS (SELECT unnest([-1,0,1]) AS d), dl AS (SELECT DISTINCT g.y+a.d AS y, g.x+b.d AS x FROM g, o a, o b), er AS (SELECT dl.y+a.d AS y, dl.x+b.d AS x FROM dl, o a, o b)
SELECT y, x FROM er GROUP BY 1,2 HAVING count(*)=9
""")
def morph_close(spark, d):
    return H.erode(H.dilate(_grid(spark, d), [], "y", "x"), [], "y", "x").select("y", "x")


@query(_GRID + """
, pt AS (SELECT CAST(p_partkey AS BIGINT) AS id, (p_partkey*7%1999)+0.25 AS py, (p_partkey*p_size%3998)+0.75 AS px FROM part), v AS (SELECT y, x, 1.0 AS v FROM g),
c AS (SELECT id, floor(py)+i AS y, floor(px)+j AS x, (CASE WHEN i=1 THEN py-floor(py) ELSE 1-(py-floor(py)) END)*(CASE WHEN j=1 THEN px-floor(px) ELSE 1-(px-floor(px)) END) AS w FROM pt, range(0,2) a(i), range(0,2) b(j))
SELECT id, round(CAST(sum(w*coalesce(v.v,0)) AS DOUBLE),6) AS ink FROM c LEFT JOIN v ON c.y=v.y AND c.x=v.x GROUP BY id
""")
def bilinear_sample(spark, d):
    pts = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 1999 + 0.25).alias("py"), (F.col("p_partkey") * F.col("p_size") % 3998 + 0.75).alias("px"))
    return H.bilinear(pts, _grid(spark, d).withColumn("ink", F.lit(1.0)), "y", "x", "ink").select("id", F.round("ink", 6).alias("ink"))


@query(_XY + """
, c AS (SELECT label, CAST(floor(x*30) AS BIGINT) AS cx, CAST(floor(y*30) AS BIGINT) AS cy FROM p), o AS (SELECT unnest([-1,0,1]) AS d),
k AS (SELECT DISTINCT cx+a.d AS cx, cy+b.d AS cy FROM c, o a, o b WHERE label<5), f AS (SELECT DISTINCT label, cx, cy FROM c WHERE label>=5)
SELECT f.label, CAST(count(*) AS BIGINT) AS cells, CAST(count(k.cx) AS BIGINT) AS claimed, round(count(k.cx)/CAST(count(*) AS DOUBLE),6) AS share FROM f LEFT JOIN k ON f.cx=k.cx AND f.cy=k.cy GROUP BY 1
""")
def claimed_overlap(spark, d):
    c = _xy(spark, d).select("label", F.floor(F.col("x") * 30).alias("cx"), F.floor(F.col("y") * 30).alias("cy"))
    k = H.dilate(c.where("label < 5"), [], "cy", "cx").withColumn("hit", F.lit(1))
    f = c.where("label >= 5").distinct().join(k, ["cx", "cy"], "left").groupBy("label")
    return f.agg(F.count("*").alias("cells"), F.count("hit").alias("claimed"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


def _peaks_sql(peaks: int, apart: int) -> str:
    out = _XY + """
, n AS (SELECT CAST(floor(y*40) AS BIGINT) AS y, CAST(floor(x*40) AS BIGINT) AS x, count(*) AS n FROM p GROUP BY 1,2), o AS (SELECT unnest(range(-2,3)) AS d),
l0 AS (SELECT n.y+a.d AS y, n.x+b.d AS x, CAST(sum(n) AS BIGINT) AS votes FROM n, o a, o b GROUP BY 1,2)"""
    for k in range(peaks):
        out += f", b{k} AS (SELECT {k} AS peak, y, x, votes FROM l{k} ORDER BY votes DESC, y, x LIMIT 1), l{k + 1} AS (SELECT l.* FROM l{k} l WHERE NOT EXISTS (SELECT 1 FROM b{k} b WHERE abs(l.y-b.y)<{apart} AND abs(l.x-b.x)<{apart}))"
    return out + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(peaks)) + ")"


@query(_peaks_sql(4, 5))
def vote_peaks(spark, d):
    votes = _xy(spark, d).groupBy(F.floor(F.col("y") * 40).alias("y"), F.floor(F.col("x") * 40).alias("x")).agg(F.count("*").alias("n"))
    return H.suppressed_peaks(H.box_sums(votes, "y", "x", "n", 2), "y", "x", "votes", 4, 5)


@query()
def greedy_cluster(spark, d):
    x = _xy(spark, d).withColumn("w", F.lit(1.0) + F.pmod(F.col("vec_id"), F.lit(5)))
    return G.clusters(x, "label", "vec_id", "x", "y", "w", 0.1)


@query()
def restore_synthetic(spark, d):
    """The raster chain on a made image: strokes on a gradient, with specks."""
    from ledgerline.operators.raster import restore

    grid = _grid(spark, d).withColumn("ink", F.lit(True))
    cells = spark.range(64 * 64).select((F.expr("id div 64")).alias("y"), (F.col("id") % 64).alias("x"))
    stroke = ((F.col("x") >= 20) & (F.col("x") < 24) & (F.col("y") > 8) & (F.col("y") < 56)) | ((F.col("y") >= 40) & (F.col("y") < 43) & (F.col("x") > 5) & (F.col("x") < 60))
    img = cells.join(grid, ["y", "x"], "left").select(F.lit(1).alias("image"), "y", "x", F.when(stroke, 40.0).when(F.col("ink"), 60.0).otherwise(180.0 + F.col("x") * 0.5).alias("v"))
    return restore(img, ["image"], "y", "x", "v", window=9, speckle=8)
