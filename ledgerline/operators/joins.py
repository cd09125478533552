"""Joins without a plain key: containment, bands, nearest, as-of, wrapped angles, set similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _grams(words: Column, n: int) -> Column:
    """Hashes of all runs of n words; null where there are fewer."""
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))
    return _let(words, lambda w: F.when(F.size(w) >= n, hashes(w)))


def contained_in(needles: DataFrame, needle_id: str, needle: str, texts: DataFrame, text_id: str, text: str, gram: int = 8) -> DataFrame:
    """(needle_id, text_id) where the text contains the needle.

    An inner word n-gram of the needle, free of what surrounds it, is the join key; ``contains`` decides. A needle too
    short to have one is looked up by its longest piece in the vocabulary of the texts (on the piece's first characters),
    and compared with the texts that have such a word. A needle without a word is found nowhere.
    """
    n = needles.select(needle_id, F.col(needle).alias("_n")).withColumn("_w", F.regexp_extract_all("_n", F.lit(WORD), F.lit(0)))
    long = n.where(F.size("_w") >= gram + 2).withColumn("_g", F.element_at(_grams(F.slice("_w", F.lit(2), F.size("_w") - 2), gram), 1))
    t = texts.select(text_id, F.col(text).alias("_t"))
    words = F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))
    hits = t.select(text_id, F.explode(F.array_distinct(_grams(words, gram))).alias("_g")).join(long.select(needle_id, "_g"), "_g").select(needle_id, text_id)
    # short ones, by the words that contain their longest piece
    by_size = F.array_sort(F.transform("_w", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x"))))
    short = n.where((F.size("_w") > 0) & (F.size("_w") < gram + 2)).withColumn("_p", F.get(by_size, F.lit(0))["x"])
    short = short.select(needle_id, "_p", F.substring("_p", 1, 3).alias("_k"))
    posted = t.select(text_id, F.explode(F.array_distinct(words)).alias("_word"))
    starts = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_word") - (k - 1))), lambda i: F.substring(F.col("_word"), i, F.lit(k)))
    vocabulary = posted.select("_word").distinct().select("_word", F.explode(F.array_distinct(F.concat(*[starts(k) for k in (1, 2, 3)]))).alias("_k"))
    with_piece = vocabulary.join(short, "_k").where(F.col("_word").contains(F.col("_p"))).select(needle_id, "_word")
    hits = hits.unionByName(posted.join(with_piece, "_word").select(needle_id, text_id)).distinct()
    return hits.join(n.select(needle_id, "_n"), needle_id).join(t, text_id).where(F.col("_t").contains(F.col("_n"))).select(needle_id, text_id)


def mandatory(left: DataFrame, key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Inner join in which every left row must find a partner: a row that has none raises an error with its key."""
    found = right.withColumn("_found", F.lit(True))
    got = left.join(found, left[key] == found[right_key], "left")
    missing = F.raise_error(F.concat(F.lit(f"no {right_key} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return got.withColumn("_found", F.when(F.col("_found"), F.lit(True)).otherwise(missing.cast("boolean"))).where("_found").drop("_found")


def band_join(left: DataFrame, x: str, right: DataFrame, y: str, width: float, keep: Column | None = None) -> DataFrame:
    """Inner join on abs(x - y) <= width (or ``keep``): both sides are dealt into cells of that width, the right one into
    its own and both neighbouring cells, and joined on the cell."""
    a = left.withColumn("_cell", F.floor(F.col(x) / width))
    at = F.floor(F.col(y) / width)
    b = right.withColumn("_cell", F.explode(F.array(at - 1, at, at + 1)))
    return a.join(b, "_cell").where(F.abs(F.col(x) - F.col(y)) <= width if keep is None else keep).drop("_cell")


def nearest(left: DataFrame, left_id: str, x: str, right: DataFrame, right_id: str, y: str, width: float, last_wins: bool = True) -> DataFrame:
    """Each left row with its nearest right row within ``width`` (inclusive); of equals the last (or first) id wins.

    Rows are told apart as rows, not by ``left_id``. Of right rows at one place only the winner is kept; both sides are sorted
    together inside cells of an eighth of the width, which also get the ends of the cells in reach, so a left row meets the
    right places before and after it and no pair is made. Places whose distances may round to one number travel together.
    """
    part, reach, close = width / 8, 9, width * 2.0**-51
    most, best = (F.max, F.max_by) if last_wins else (F.min, F.min_by)
    at, cell = F.col("_at"), F.floor(F.col("_at") / part).alias("_cell")
    place = right.select(F.col(y).cast("double").alias("_at"), F.struct(F.col(right_id).isNotNull().alias("known"), F.col(right_id).alias("id")).alias("_id"), F.struct("*").alias("_r"))
    place = place.where(F.abs(at) < float("inf")).groupBy("_at").agg(most("_id").alias("_id"), best("_r", "_id").alias("_r"))
    inside = Window.partitionBy("_cell").orderBy("_at")
    place = place.select("*", cell).withColumn("_new", F.coalesce(at - F.lag("_at").over(inside) > close, F.lit(True)))
    place = place.withColumn("_run", F.sum(F.col("_new").cast("int")).over(inside)).groupBy("_cell", "_run").agg(F.min("_at").alias("_first"), F.collect_list(F.struct("_at", "_id", "_r")).alias("_p"))
    place = place.select("_cell", F.col("_first").alias("_at"), "_p")
    ends = place.groupBy("_cell").agg(F.min_by(F.struct("_at", "_p"), "_at").alias("a"), F.max_by(F.struct("_at", "_p"), "_at").alias("z"))
    ends = ends.select("*", F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_o")).select(F.explode(F.array(F.struct((F.col("_cell") - F.col("_o")).alias("_cell"), F.col("a").alias("e")), F.struct((F.col("_cell") + F.col("_o")).alias("_cell"), F.col("z").alias("e")))).alias("_e"))
    place = place.unionByName(ends.select("_e._cell", "_e.e._at", "_e.e._p"))
    rows = left.select(F.col(x).cast("double").alias("_at"), F.struct("*").alias("_l")).where(F.abs(at) < float("inf")).select("*", cell)
    rows = rows.join(place.select("_cell").distinct(), "_cell", "left_semi")
    both = place.withColumn("_l", F.lit(None).cast(rows.schema["_l"].dataType)).unionByName(rows.withColumn("_p", F.lit(None).cast(place.schema["_p"].dataType)))
    met = lambda o: F.coalesce(F.last("_p", True).over(Window.partitionBy("_cell").orderBy(o, F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)), F.array())
    both = both.select("_l", "_at", met(F.asc("_at")).alias("_a"), met(F.desc("_at")).alias("_z")).where("_l is not null")
    far = F.transform(F.concat("_a", "_z"), lambda c: F.struct(F.abs(at - c["_at"]).alias("d"), c["_id"].alias("id"), c["_r"].alias("r")))
    both = both.select("_l", far.alias("_c")).select("_l", "_c", F.array_min(F.transform("_c", lambda c: c["d"])).alias("_d")).where(F.col("_d") <= width)
    least = F.filter("_c", lambda c: c["d"] == F.col("_d"))
    ahead = (lambda m, c: c["id"] > m["id"]) if last_wins else (lambda m, c: c["id"] < m["id"])
    won = F.aggregate(least, F.element_at(least, 1), lambda m, c: F.when(ahead(m, c), c).otherwise(m))
    return both.select("_l", won["r"].alias("_r")).select("_l.*", "_r.*")


def interpolate(points: DataFrame, key: str, at: str, value: str, probes: DataFrame, probe_at: str, width: float | None = None) -> DataFrame:
    """As-of join on both sides: linear interpolation between the bracketing points, clamped at the ends.

    points has one row for each (key, at). Probes and points are sorted together inside cells of ``width`` along ``at``;
    a cell's neighbours are known by their first and last points only, so no task sorts a key and no pair is made. Without a
    width, one is taken from the range and the number of the rows: about 10,000 rows a cell, if they lie evenly.
    """
    p = points.select(key, F.col(at).cast("double").alias("_at"), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_probe"))
    q = probes.select(key, F.col(probe_at).cast("double").alias("_at"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_probe"))
    both = p.unionByName(q)
    if width is None:
        n, low, high = both.agg(F.count("_at"), F.min("_at"), F.max("_at")).first()
        width = (high - low) / max(1, n // 10_000) or 1.0 if n else 1.0
    both = both.withColumn("_cell", F.floor(F.col("_at") / width)).withColumn("_p", F.when(F.col("_probe") == 0, F.struct(F.col("_at").alias("x"), F.col("_v").alias("y"))))
    ends = both.groupBy(key, "_cell").agg(F.min("_p").alias("_first"), F.max("_p").alias("_last"))
    cells = lambda o: Window.partitionBy(key).orderBy(o).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  one row a cell
    ends = ends.select(key, "_cell", F.last("_last", True).over(cells(F.asc("_cell"))).alias("_left"), F.last("_first", True).over(cells(F.desc("_cell"))).alias("_right"))
    inside = lambda *o: Window.partitionBy(key, "_cell").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_a", F.last("_p", True).over(inside(F.asc("_at"), F.asc("_probe")))).withColumn("_z", F.last("_p", True).over(inside(F.desc("_at"), F.asc("_probe"))))
    both = both.where("_probe = 1").join(ends, [key, "_cell"]).withColumn("_a", F.coalesce("_a", "_left")).withColumn("_z", F.coalesce("_z", "_right"))
    x0, y0, x1, y1 = F.col("_a.x"), F.col("_a.y"), F.col("_z.x"), F.col("_z.y")
    v = F.when(x0.isNull(), y1).when(x1.isNull() | (x1 == x0), y0).otherwise(y0 + (F.col("_at") - x0) / (x1 - x0) * (y1 - y0))
    return both.select(key, F.col("_at").alias(probe_at), v.alias(value))


def wrapped_gap(a: Column, b: Column, full: float = 360.0) -> Column:
    """Least distance of two angles."""
    return F.abs(F.pmod(a - b + full / 2, F.lit(full)) - full / 2)


def wrapped_band_join(left: DataFrame, x: str, right: DataFrame, y: str, width: float, full: float = 360.0) -> DataFrame:
    """Inner join on the wrapped distance of angles in [0, full) being at most ``width``, which divides ``full``."""
    cells = int(full / width)
    a = left.withColumn("_cell", F.floor(F.col(x) / width))
    at = F.floor(F.col(y) / width)
    b = right.withColumn("_cell", F.explode(F.array_distinct(F.array(*[F.pmod(at + k, F.lit(cells)) for k in (-1, 0, 1)]))))
    return a.join(b, "_cell").where(wrapped_gap(F.col(x), F.col(y), full) <= width).drop("_cell")


def overlaps(left: DataFrame, left_id: str, right: DataFrame, right_id: str, words: str, least: float) -> DataFrame:
    """Set overlap |A & B| / min(|A|, |B|) of pairs from ``least`` on: left_id, right_id, shared, overlap.

    Both sides have an array of distinct words. The smaller set of such a pair shares at least one of its rarest words, as
    many as it can miss and one more; only those are joined with the other side's words, so frequent words make no pairs.
    """
    sides = [(left.select(left_id, F.col(words).alias("_ws")), left_id), (right.select(right_id, F.col(words).alias("_ws")), right_id)]
    every = [x.select(i, F.size("_ws").alias("_n"), F.explode("_ws").alias("_w")) for x, i in sides]
    freq = every[0].select("_w").unionByName(every[1].select("_w")).groupBy("_w").agg(F.count("*").alias("_f"))

    def rarest(x: DataFrame, i: str) -> DataFrame:
        ranked = x.join(freq, "_w").withColumn("_r", F.row_number().over(Window.partitionBy(i).orderBy("_f", "_w")))
        return ranked.where(F.col("_r") <= F.col("_n") - F.ceil(F.col("_n") * least - 1e-9) + 1).select(i, "_w")

    a, b = every
    pairs = rarest(a, left_id).join(b.select(right_id, "_w"), "_w").select(left_id, right_id)
    pairs = pairs.unionByName(a.select(left_id, "_w").join(rarest(b, right_id), "_w").select(left_id, right_id)).distinct()
    got = pairs.join(sides[0][0].withColumnRenamed("_ws", "_a"), left_id).join(sides[1][0].withColumnRenamed("_ws", "_b"), right_id)
    got = got.withColumn("shared", F.size(F.array_intersect("_a", "_b")).cast("long")).withColumn("overlap", F.col("shared") / F.least(F.size("_a"), F.size("_b")))
    return got.where(F.col("overlap") >= least).select(left_id, right_id, "shared", "overlap")


def best_match(pairs: DataFrame, key: str, other: str, score: str, least: float, margin: float) -> DataFrame:
    """The best pair of each key when it reaches ``least`` and leads the runner-up by ``margin``: pairs below least - margin
    may be absent."""
    w = Window.partitionBy(key).orderBy(F.desc(score), other)
    top = pairs.withColumn("_n", F.row_number().over(w)).where("_n <= 2").withColumn("_next", F.lead(score).over(w))
    return top.where((F.col("_n") == 1) & (F.col(score) >= least) & (F.col(score) - F.coalesce("_next", F.lit(0.0)) >= margin)).drop("_n", "_next")
