"""Catalog: ordered series, histograms, as-of and nearest joins, over events and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.time import seconds
from ledgerline.operators import greedy as G
from ledgerline.operators import grids as H
from ledgerline.operators import joins as J
from ledgerline.operators import ranks as R
from ledgerline.operators import series as S
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


def _hour():
    """Cells along the order of events."""
    return F.date_trunc("hour", "ts")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING),6) AS smooth FROM events")
def smooth_series(spark, d):
    return S.smooth(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value", 21, "smooth", _hour()).select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""
WITH m AS (SELECT event_id, event_type, ts, max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mx FROM events)
SELECT event_id, min(mx) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS closed FROM m
""")
def sliding_close(spark, d):
    return S.closing(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value", 5, "closed", _hour()).select("event_id", "closed")


_DAYS = "WITH dd AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1,2)"


def _days(spark, d):
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    return table(spark, d, "events").groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"))


@query(_DAYS + """
, w AS (SELECT *, lag(n) OVER o AS p, lead(n) OVER o AS q, max(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM dd WINDOW o AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, n, round(least(0.6, greatest(-0.6, CASE WHEN abs(p-2*n+q)>1e-9 THEN 0.5*(p-q)/(p-2*n+q) ELSE 0 END)),6)+0 AS peak_offset FROM w WHERE n>=p AND n>=q AND n=m
""")
def peak_bins(spark, d):
    p = S.peaks(_days(spark, d), ["event_type"], ["day"], "n", 0, reach=3)
    return p.select("event_type", "day", "n", F.round("offset", 6).alias("peak_offset"))


@query("""
WITH a AS (SELECT user_id, event_id, ts, value*7.3 - floor(value*7.3/360)*360 AS angle FROM events),
b AS (SELECT *, CASE WHEN angle < lag(angle) OVER w - 180 THEN 360.0 ELSE 0.0 END AS s FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(angle + sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),6) AS unwrapped FROM b
""")
def unwrap_phase(spark, d):
    a = table(spark, d, "events").withColumn("angle", F.col("value") * 7.3 - F.floor(F.col("value") * 7.3 / 360) * 360)
    return S.unwrap(a, ["user_id"], ["ts", "event_id"], "angle", "u").select("event_id", F.round("u", 6).alias("unwrapped"))


@query("""
WITH b AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts)-epoch(lag(ts) OVER w) > 3*86400 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM b)
SELECT user_id, CAST(seg AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_event FROM c GROUP BY 1,2
""")
def segment_gaps(spark, d):
    e = table(spark, d, "events").withColumn("sec", seconds(F.col("ts")))
    g = S.islands(e, ["ts", "event_id"], lambda w: F.col("sec") - F.lag("sec").over(w) > 3 * 86400, "segment", ["user_id"])
    return g.groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


_HOURS = "WITH h AS (SELECT DISTINCT user_id, CAST(hour(ts) AS BIGINT) AS hour FROM events)"


@query(_HOURS + """
, g AS (SELECT user_id, coalesce(lead(hour) OVER w, first_value(hour) OVER w + 24) - hour - 1 AS gap FROM h WINDOW w AS (PARTITION BY user_id ORDER BY hour))
SELECT user_id, CAST(max(gap) AS BIGINT) AS gap FROM g GROUP BY user_id
""")
def longest_circular_gap(spark, d):
    e = table(spark, d, "events").select("user_id", F.hour("ts").cast("long").alias("hour"))
    return S.longest_circular_gap(e, ["user_id"], "hour", 24)


_GROUPS = _HOURS + """
, i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY hour) AS g FROM (SELECT *, CASE WHEN lag(hour) OVER w IS NULL OR hour-lag(hour) OVER w>2 THEN 1 ELSE 0 END AS b FROM h WINDOW w AS (PARTITION BY user_id ORDER BY hour))),
j AS (SELECT *, max(g) OVER (PARTITION BY user_id) AS mg, 24-max(hour) OVER (PARTITION BY user_id)+min(hour) OVER (PARTITION BY user_id)<=2 AS wraps FROM i),
k AS (SELECT user_id, hour, CAST(CASE WHEN wraps AND mg>1 AND g=mg THEN 1 ELSE g END AS BIGINT) AS grp FROM j),
u AS (SELECT *, CASE WHEN max(hour) OVER (PARTITION BY user_id,grp)-min(hour) OVER (PARTITION BY user_id,grp)>12 AND hour<12 THEN hour+24 ELSE hour END AS unrolled FROM k)
"""


@query(_GROUPS + "SELECT user_id, grp AS group_no, min(unrolled) AS first_hour, max(unrolled) AS last_hour, CAST(count(*) AS BIGINT) AS hours FROM u GROUP BY 1,2")
def circular_groups(spark, d):
    h = table(spark, d, "events").select("user_id", F.hour("ts").cast("long").alias("hour")).distinct()
    g = S.circular_groups(h, ["user_id"], "hour", 24, 2)
    return g.groupBy("user_id", F.col("group").alias("group_no")).agg(F.min("unrolled").alias("first_hour"), F.max("unrolled").alias("last_hour"), F.count("*").alias("hours"))


@query(_GROUPS + """
, n AS (SELECT user_id, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS c FROM events GROUP BY 1,2), a AS (SELECT user_id, grp, sum(unrolled*c)/sum(c) AS m FROM u JOIN n USING (user_id,hour) GROUP BY 1,2)
SELECT user_id, grp AS group_no, round(m - floor(m/24)*24,6) AS centre FROM a
""")
def weighted_circular_centroid(spark, d):
    h = table(spark, d, "events").groupBy("user_id", F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("c"))
    g = S.circular_groups(h, ["user_id"], "hour", 24, 2).groupBy("user_id", F.col("group").alias("group_no"))
    m = F.sum(F.col("unrolled") * F.col("c")) / F.sum("c")
    return g.agg(m.alias("m")).select("user_id", "group_no", F.round(F.pmod("m", F.lit(24.0)), 6).alias("centre"))


@query("""
SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p<>event_type
""")
def decimate_consecutive(spark, d):
    return S.changes(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type")


@query(_DAYS + """
, s AS (SELECT *, (day - min(day) OVER (PARTITION BY event_type))//7 AS stretch FROM dd)
SELECT event_type, CAST(stretch AS BIGINT) AS stretch, CAST(count(*) AS BIGINT) AS n, round(regr_slope(n,day),6)+0 AS slope FROM s GROUP BY 1,2 HAVING count(*)>3
""")
def turn_regression(spark, d):
    g = S.window_slopes(_days(spark, d), ["event_type"], "day", "n", 7, 3)
    return g.select("event_type", F.col("stretch").cast("long").alias("stretch"), "n", F.round("slope", 6).alias("slope"))


@query("""
WITH p AS (SELECT event_type, epoch(ts) AS t, avg(value) AS v FROM events GROUP BY 1,2), q AS (SELECT event_type, 1704067200.0 + 3600.0*i AS t FROM (SELECT DISTINCT event_type FROM events), range(0,720) r(i)),
a AS (SELECT q.event_type, q.t, p.t AS x0, p.v AS y0 FROM q ASOF LEFT JOIN p ON q.event_type=p.event_type AND q.t>=p.t), b AS (SELECT a.*, p.t AS x1, p.v AS y1 FROM a ASOF LEFT JOIN p ON a.event_type=p.event_type AND a.t<=p.t)
SELECT event_type, CAST(t AS DOUBLE) AS t, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1=x0 THEN y0 ELSE y0+(t-x0)/(x1-x0)*(y1-y0) END,4) AS value FROM b
""")
def interpolate_asof(spark, d):
    e = table(spark, d, "events").groupBy("event_type", (seconds(F.col("ts"))).alias("t")).agg(F.avg("value").alias("value"))
    q = e.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(719))).alias("i")).select("event_type", (F.lit(1704067200.0) + F.col("i") * 3600.0).alias("t"))
    return J.interpolate(e, "event_type", "t", "value", q, "t", 3600.0).select("event_type", "t", F.round("value", 4).alias("value"))


@query("""
WITH b AS (SELECT CAST(least(255, floor(l_extendedprice/400)) AS INTEGER) AS bin FROM lineitem), h AS (SELECT CAST(i AS INTEGER) AS bin, count(b.bin) AS n FROM range(0,256) r(i) LEFT JOIN b ON b.bin=i GROUP BY 1),
p AS (SELECT bin, n/CAST(sum(n) OVER () AS DOUBLE) AS p FROM h), c AS (SELECT bin, sum(p) OVER (ORDER BY bin) AS om, sum(p*bin) OVER (ORDER BY bin) AS mu, sum(p*bin) OVER () AS t FROM p),
v AS (SELECT bin, CASE WHEN om*(1-om)>1e-12 THEN round((t*om-mu)*(t*om-mu)/(om*(1-om)),6) ELSE 0 END AS v FROM c)
SELECT bin AS threshold, round(v,3) AS variance FROM v ORDER BY v.v DESC, bin LIMIT 1
""")
def otsu_threshold(spark, d):
    h = H.histogram(table(spark, d, "lineitem"), F.least(F.lit(255), F.floor(F.col("l_extendedprice") / 400)))
    return H.otsu(h).select("threshold", F.round("variance", 3).alias("variance"))


@query("""
SELECT l_returnflag, CAST(count_if(l_quantity<10) AS BIGINT) AS ink, round(count_if(l_quantity<10)/CAST(count(*) AS DOUBLE),6) AS fraction, round(quantile_cont(l_extendedprice,0.9),4) AS p90 FROM lineitem GROUP BY 1
""")
def threshold_mask_stats(spark, d):
    ink = F.col("l_quantity") < 10
    li = table(spark, d, "lineitem")
    g = li.groupBy("l_returnflag").agg(F.count_if(ink).alias("ink"), F.round(F.count_if(ink) / F.count("*"), 6).alias("fraction"))
    return g.join(R.quantiles(li, "l_returnflag", "l_extendedprice", {"p90": 0.9}), "l_returnflag").withColumn("p90", F.round("p90", 4))


@query("""
SELECT l_returnflag, round(median(l_extendedprice),4) AS median, round(quantile_cont(l_extendedprice,0.95),4) AS p95, round((list(l_extendedprice ORDER BY l_extendedprice))[CAST(count(*)//2 AS BIGINT)+1],4) AS upper_median FROM lineitem GROUP BY 1
""")
def median_variants(spark, d):
    """The upper median is the value at rank n div 2 (from 0)."""
    got = R.quantiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", {"median": 0.5, "p95": 0.95}, {"upper_median": 0.5})
    return got.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("median", "p95", "upper_median")])


@query("""
WITH p AS (SELECT p_partkey, p_retailprice AS u FROM part), c AS (SELECT row_number() OVER () AS cid, l_extendedprice/10 AS x, l_quantity AS a FROM lineitem ),
j AS (SELECT cid, a, x, p_partkey, u, row_number() OVER (PARTITION BY cid ORDER BY abs(x-u), p_partkey DESC) AS n FROM c JOIN p ON abs(x-u)<=7)
SELECT p_partkey, CAST(count(*) AS BIGINT) AS hits, round(sum(x*a)/sum(a),6) AS position FROM j WHERE n=1 GROUP BY 1 HAVING count(*)>=2 AND sum(a)>=20
""")
def snap_nearest(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("u"))
    c = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 10).alias("x"), F.col("l_quantity").alias("a"))
    g = J.nearest(c, "l_orderkey", "x", p, "p_partkey", "u", 7.0).groupBy("p_partkey")
    g = g.agg(F.count("*").alias("hits"), F.sum("a").alias("area"), F.round(F.sum(F.col("x") * F.col("a")) / F.sum("a"), 6).alias("position"))
    return g.where("hits >= 2 and area >= 20").drop("area")


@query("""
WITH d AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY 1,2),
x AS (SELECT day, n AS a FROM d WHERE event_type=(SELECT min(event_type) FROM events)), y AS (SELECT day, n AS b FROM d WHERE event_type=(SELECT max(event_type) FROM events)),
s AS (SELECT CAST(k AS BIGINT) AS shift FROM range(-5,6) r(k)), c AS (SELECT shift, sum(a*b) AS score FROM x, s JOIN y ON y.day=x.day+shift GROUP BY 1)
SELECT shift, CAST(score AS BIGINT) AS score FROM c ORDER BY score DESC, shift LIMIT 1
""")
def xcorr_offset(spark, d):
    days = _days(spark, d)
    ends = days.groupBy().agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    both = days.join(F.broadcast(ends))  # one row
    a = both.where("event_type = lo").select("day", F.col("n").alias("a"), F.explode(F.sequence(F.lit(-5).cast("long"), F.lit(5).cast("long"))).alias("shift"))
    b = both.where("event_type = hi").select(F.col("day").alias("other"), F.col("n").alias("b"))
    c = a.withColumn("other", F.col("day") + F.col("shift")).join(b, "other").groupBy("shift").agg(F.sum(F.col("a") * F.col("b")).alias("score"))
    return c.groupBy().agg(F.max_by("shift", F.struct("score", -F.col("shift"))).alias("shift"), F.max("score").alias("score"))


@query("""
WITH t AS (SELECT CAST(k AS INTEGER) AS variant, l_quantity<k AS ink, l_extendedprice AS v FROM lineitem, range(5,50,5) r(k)),
m AS (SELECT variant, count_if(ink) AS ink, median(CASE WHEN ink THEN v END) AS med, quantile_cont(CASE WHEN ink THEN v END,0.9) AS p90 FROM t GROUP BY 1)
SELECT variant, CAST(ink AS BIGINT) AS ink, round(med,4) AS median, round(p90,4) AS p90, variant=(SELECT min_by(variant, abs(ink-(SELECT count(*) FROM lineitem)/2.0)*1000+variant) FROM m) AS winner FROM m
""")
def sweep_select(spark, d):
    li = table(spark, d, "lineitem").select("l_quantity", F.col("l_extendedprice").alias("v"), F.explode(F.array(*[F.lit(k) for k in range(5, 50, 5)])).alias("variant"))
    inked = F.when(F.col("l_quantity") < F.col("variant"), F.col("v"))
    m = li.groupBy("variant").agg(F.count(inked).alias("ink"), F.count("*").alias("all"))
    q = R.quantiles(li.select("variant", inked.alias("v")), "variant", "v", {"median": 0.5, "p90": 0.9})
    m = m.join(q, "variant", "left").withColumns({c: F.round(c, 4) for c in ("median", "p90")})
    from pyspark.sql import Window

    first = F.row_number().over(Window.orderBy(F.abs(F.col("ink") - F.col("all") / 2), "variant"))  # one row a variant
    return m.select("variant", "ink", "median", "p90", (first == 1).alias("winner"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag='R' AS crest, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)-1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey FROM lineitem),
c AS (SELECT *, min(CASE WHEN crest THEN i END) OVER (PARTITION BY l_orderkey) AS k FROM l)
SELECT l_orderkey, CAST(i AS BIGINT) AS idx, round(CASE WHEN i=0 THEN 180.0 WHEN i<=k THEN 180.0-90.0*i/k ELSE 90.0-90.0*(i-k)/(n-k) END,6) AS position FROM c WHERE k IS NOT NULL
""")
def predict_positions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    whole = Window.partitionBy("l_orderkey")
    li = table(spark, d, "lineitem").withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(whole))
    li = li.withColumn("k", F.min(F.when(F.col("l_returnflag") == "R", F.col("i"))).over(whole)).where("k is not null")
    i, k, n = F.col("i"), F.col("k"), F.col("n")
    u = F.when(i == 0, 180.0).when(i <= k, 180.0 - 90.0 * i / k).otherwise(90.0 - 90.0 * (i - k) / (n - k))
    return li.select("l_orderkey", i.cast("long").alias("idx"), F.round(u, 6).alias("position"))


@query(_DAYS + """
, w AS (SELECT *, lag(n) OVER o AS p, lead(n) OVER o AS q FROM dd WINDOW o AS (PARTITION BY event_type ORDER BY day)),
r AS (SELECT event_type, day + least(0.6, greatest(-0.6, CASE WHEN abs(p-2*n+q)>1e-9 THEN 0.5*(p-q)/(p-2*n+q) ELSE 0 END)) AS place, day FROM w WHERE n>=p AND n>=q)
SELECT event_type, round(place-15,6)+0 AS deviation FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(place-15), day) AS k FROM r WHERE abs(place-15)<=6) WHERE k=1
""")
def ridge_track(spark, d):
    from pyspark.sql import Window

    p = S.peaks(_days(spark, d), ["event_type"], ["day"], "n", 0).withColumn("place", F.col("day") + F.col("offset")).where("abs(place - 15) <= 6")
    w = Window.partitionBy("event_type").orderBy(F.abs(F.col("place") - 15), "day")
    return p.withColumn("k", F.row_number().over(w)).where("k = 1").select("event_type", F.round(F.col("place") - 15, 6).alias("deviation"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS lo, epoch(ts)+6*3600 AS hi, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events),
w AS (SELECT user_id, k, event_id, CASE WHEN true THEN 0 END AS tier, false AS forced, [lo, 1e18, 1e18] AS free FROM e WHERE k=1
 UNION ALL SELECT e.user_id, e.k, e.event_id, t.tier, t.forced, CASE WHEN t.forced THEN free ELSE [CASE WHEN t.tier=i-1 THEN e.lo ELSE free[i] END FOR i IN [1,2,3]] END
 FROM w JOIN e ON e.user_id=w.user_id AND e.k=w.k+1, LATERAL (SELECT CASE WHEN e.hi<=free[1] THEN 0 WHEN e.hi<=free[2] THEN 1 ELSE 2 END AS tier, e.hi>free[1] AND e.hi>free[2] AND e.hi>free[3] AS forced) t)
SELECT user_id, event_id, CAST(tier AS INTEGER) AS tier, forced FROM w
""")
def greedy_tiers(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (seconds(F.col("ts"))).alias("lo")).withColumn("hi", F.col("lo") + F.lit(6 * 3600.0))
    return G.tiers(e, "user_id", "event_id", "lo", "hi", 3)


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT user_id, event_id, k, value, false AS changed FROM e WHERE k=1
 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.value>=w.value THEN w.value-1 ELSE e.value END, e.value>=w.value FROM w JOIN e ON e.user_id=w.user_id AND e.k=w.k+1)
SELECT user_id, event_id, value, changed FROM w
""")
def monotonic_guard(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    return G.guard(e, "user_id", "event_id", "ts", "value")


_STRAND = """
WITH o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT user_id, i, (i*10.0 + CASE WHEN i>=n/2.0 AND user_id%3=0 THEN 20.0 ELSE 0.0 END) AS t, 100.0+i*2.0 - CASE WHEN i>=n/2.0 AND user_id%3=0 THEN 68.0 ELSE 0.0 END AS r FROM o),
a AS (SELECT user_id, i, t - floor(t/360)*360 AS theta, r FROM s),
b AS (SELECT *, CASE WHEN theta < lag(theta) OVER w - 180 THEN 360.0 ELSE 0.0 END AS drop_ FROM a WINDOW w AS (PARTITION BY user_id ORDER BY i)),
u AS (SELECT user_id, i, theta + sum(drop_) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS u, r FROM b),
p AS (SELECT *, row_number() OVER w AS k, u - lag(u) OVER w AS du, abs(r - lag(r) OVER w) AS dr, lag(u) OVER w AS end_ FROM u WINDOW w AS (PARTITION BY user_id ORDER BY u, i)),
m AS (SELECT user_id, u, avg(r) AS r FROM u GROUP BY 1,2),
z AS (SELECT p.user_id, p.k, p.u-360 AS t, p.r, m.u AS x0, m.r AS y0 FROM p ASOF JOIN m ON p.user_id=m.user_id AND p.u-360>=m.u),
y AS (SELECT z.*, m.u AS x1, m.r AS y1 FROM z ASOF JOIN m ON z.user_id=m.user_id AND z.t<=m.u),
f AS (SELECT user_id, k, t, abs(r - CASE WHEN x1=x0 THEN y0 ELSE y0+(t-x0)/(x1-x0)*(y1-y0) END) AS off FROM y),
c AS (SELECT p.user_id, p.k, count(*) AS n, list(f.off ORDER BY f.off) AS offs FROM p JOIN f ON p.user_id=f.user_id AND f.k>=p.k AND f.t<=p.end_ WHERE p.dr>60 AND p.du>10 GROUP BY 1,2),
q AS (SELECT user_id, min(k) AS at FROM c WHERE offs[n//2+1]<30 GROUP BY 1),
v AS (SELECT p.user_id, p.u - CASE WHEN p.k>=q.at THEN 360 ELSE 0 END AS u, p.r FROM p LEFT JOIN q USING (user_id)),
g AS (SELECT user_id, u, avg(r) AS r FROM v GROUP BY 1,2),
h AS (SELECT *, CASE WHEN lag(u) OVER w IS NULL OR abs(r-lag(r) OVER w)>40 OR u-lag(u) OVER w>15 THEN 1 ELSE 0 END AS new_ FROM g WINDOW w AS (PARTITION BY user_id ORDER BY u)),
e AS (SELECT *, CAST(sum(new_) OVER (PARTITION BY user_id ORDER BY u ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM h),
w AS (SELECT *, avg(r) OVER (PARTITION BY user_id, segment ORDER BY u ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS smooth, count(*) OVER (PARTITION BY user_id, segment) AS size FROM e)
SELECT user_id, round(u,6) AS u, round(r,6) AS r, round(smooth,6) AS smooth, segment FROM w WHERE size>=3
"""


@query(_STRAND)
def turn_repair(spark, d):
    """A spiral a user: the radius grows with the event's order, and the tail of every third one re-traces the head.

    Unwrapped, then the tail behind the first jump that re-traces the head a turn earlier goes back a turn; points of one
    angle become one; what is left is split at jumps and smoothed.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    late = (F.col("i") >= F.col("n") / 2) & (F.col("user_id") % 3 == 0)
    theta = F.pmod(F.col("i") * 10.0 + F.when(late, 20.0).otherwise(0.0), F.lit(360.0))
    e = e.select("user_id", "i", theta.alias("theta"), (100.0 + F.col("i") * 2.0 - F.when(late, 68.0).otherwise(0.0)).alias("r"))
    return S.repaired_strand(e, "user_id", "i", "theta", "r").select("user_id", *[F.round(c, 6).alias(c) for c in ("u", "r", "smooth")], "segment")
