"""Operator 5: document fingerprints of closed syncmers (DataFrame functions only).

A k-mer of ``K`` bytes of UTF-8 is an anchor when the least hash of its substrings of ``S`` bytes
stands at its first or last place. That depends on the k-mer alone, so an anchor survives any
edit outside it. A mark is an anchor's 64-bit hash with the distance to the next anchor; a
fingerprint is a text's marks in order. Two texts match at a mark where the same anchors stand
at the same distance, wherever in the text; a likeness is the Jaccard index of two sets of marks.

Places are rows of generated code, not calls of a lambda: a text becomes one row a place, a
filter keeps the anchors (the edges' hashes first; inner ones until one is smaller), and an
aggregation inside the task puts them together again. Only the row at place -1 carries the text.

Because anchors are free of context, marks of an edited text (a prefix of one text, then a prefix
of another) are those of both texts and the few across the seam. Each text is scanned once.

``next document`` pairs each document with the one of the next smaller id. Documents are dealt by
ranges of ids of about ``RANGE_BYTES`` of text (bounds from an approximate quantile sketch over
all ids; a search by levels) and sorted; a copy of each range's first document closes the range
before, so one shuffle of the texts is enough. There are as many tasks as ranges.

Defined results: a null text is empty; a text without anchors (as any of fewer than K bytes)
has the hash of the whole text as its only mark; null ids come last; equal ids are ordered by a
hash of the text; a lone document is its own next one; an empty table gives no rows; other
columns of the input are ignored. The id column must be of an integer type.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import integer_id, table

S, SPAN = 8, 16  # bytes of a substring; substrings in a k-mer
K = S + SPAN - 1
#: Text of a range; children of a node of the search for a range, and its levels: FAN ** LEVELS ranges at most.
RANGE_BYTES, FAN, LEVELS = 4 << 20, 128, 3


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _hash_at(data: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.substring(data, at + 1, F.lit(size)))


def anchor_rows(df: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """``carry``, text (at place -1 only), at, hash: a row for each row of df and one for each anchor of its text."""
    # the generator reads the bytes, so generated code has them at hand before it walks the places
    rows = df.select(*carry, F.col(text_col).cast("binary").alias("_d"))
    rows = rows.select(*carry, "_d", F.explode(F.sequence(F.lit(-1), F.greatest(F.lit(-1), F.octet_length("_d") - K))).alias("at"))
    data, at = F.col("_d"), F.col("at")
    least = F.least(_hash_at(data, at, S), _hash_at(data, at + (SPAN - 1), S))
    rows = rows.select("*", F.explode(F.array(least)).alias("_least"))  # once a place; a plain column would be put into every comparison
    inner = reduce(lambda x, y: x & y, [F.col("_least") <= _hash_at(data, at + k, S) for k in range(1, SPAN - 1)])
    rows = rows.where((at < 0) | inner)
    return rows.select(*carry, F.when(at < 0, data.cast("string")).alias("text"), "at", F.when(at >= 0, _hash_at(data, at, K)).alias("hash"))


def short_anchors(data: Column) -> Column:
    """The same anchors, as array<struct<at, hash>>, of a few bytes."""

    def found(h):
        inside = lambda i: F.least(h[i], h[i + (SPAN - 1)]) <= F.array_min(F.slice(h, i + 2, F.lit(SPAN - 2)))
        return F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - SPAN), inside), lambda i: F.struct(i.alias("at"), _hash_at(data, i, K).alias("hash")))

    every = F.transform(F.sequence(F.lit(0), F.octet_length(data) - S), lambda i: _hash_at(data, i, S))
    none = F.expr("cast(array() as array<struct<at:int,hash:bigint>>)")
    return F.when(F.octet_length(data) >= K, _let(every, found)).otherwise(none)


def marks(found: Column) -> Column:
    """array<bigint>: each anchor of an array in order with the distance to the next."""
    after = F.concat(F.slice(found.getField("at"), F.lit(2), F.greatest(F.lit(0), F.size(found) - 1)), F.array(F.lit(-1)))
    return F.when(F.size(found) > 0, F.zip_with(found, after, lambda x, n: F.xxhash64(x.hash, F.greatest(n - x.at, F.lit(-1))))).otherwise(F.expr("cast(array() as array<bigint>)"))


def _or_whole(marks: Column, text: Column) -> Column:
    return F.when(F.size(marks) > 0, marks).otherwise(F.array(F.xxhash64(text)))


def fingerprint(marks: Column) -> Column:
    """The marks as text, in order."""
    return F.array_join(marks.cast("array<string>"), " ")


def likeness(x: Column, y: Column) -> Column:
    """Jaccard index of two arrays of marks, neither empty."""
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _range(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key, by a search of FAN children a level."""
    if not bounds:
        return F.lit(0)
    tree: list = bounds
    for _ in range(LEVELS - 1):
        tree = [tree[i : i + FAN] for i in range(0, len(tree), FAN)]
    node, found = F.from_json(F.lit(json.dumps(tree)), "array<" * LEVELS + "bigint" + ">" * LEVELS), F.lit(0)
    for level in range(LEVELS - 1, -1, -1):
        n = F.size(F.filter(node, lambda child: reduce(lambda c, _: c[0], range(level), child) <= key))
        if level:
            child = F.greatest(n, F.lit(1))
            found, node = found + (child - 1) * FAN**level, F.element_at(node, child)
        else:
            found = found + n
    return found.cast("int")


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, anchors, marks, and next_ of each: those of the document of the next smaller id (of the last: the first's)."""
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    docs = docs.select(integer_id(docs, id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", key)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(FAN**LEVELS, -(-size // RANGE_BYTES)))
    probs = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("key", probs, 4 * ranges).alias("b")).first()["b"] if probs else []  # FAN ** LEVELS numbers at most
    bounds = sorted(set(found or []))
    docs = docs.withColumn("range", _range(F.col("key"), bounds)).withColumn("tie", F.xxhash64("text"))
    heads = docs.groupBy("range").agg(F.max("key").alias("key"))
    order = Window.partitionBy().orderBy("range")  # one row a range
    heads = heads.withColumn("into", F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy()))).select("key", "into")
    ghosts = docs.join(F.broadcast(heads), "key").select(F.col("into").alias("range"), F.lit(1).alias("ghost"), "key", "tie", "doc_id", "text")
    rows = docs.select("range", F.lit(0).alias("ghost"), "key", "tie", "doc_id", "text").unionByName(ghosts)
    # every range is a task of its own, so neither the aggregation nor the window needs a further exchange
    rows = rows.repartitionById(len(bounds) + 1, F.col("range"))
    one = ["range", "ghost", "key", "tie", "doc_id"]
    pair = F.when(F.col("at") >= 0, F.struct("at", "hash"))
    rows = anchor_rows(rows, "text", one).groupBy(*one).agg(F.max("text").alias("text"), F.count("text").alias("copies"), F.collect_list(pair).alias("anchors"))
    rows = rows.withColumn("anchors", F.sort_array(F.when(F.col("copies") > 1, F.array_distinct("anchors")).otherwise(F.col("anchors"))))
    rows = rows.withColumn("marks", marks(F.col("anchors"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    w = Window.partitionBy("range").orderBy("ghost", F.desc("key"), "tie")
    named = ["text", "anchors", "marks"]
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in named})
    return rows.where("ghost = 0").select("doc_id", *named, *[f"next_{c}" for c in named])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = with_next(docs, id_col=id_col, text_col=text_col).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("own", F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int"))).withColumn("head", F.substring("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited_text", F.concat("own", "head")).withColumn("stay", F.octet_length("own")).withColumn("come", F.octet_length("head"))
    # whole anchors before and after the seam; between the last and the first of them, those across it
    whole = lambda found, upto: F.size(F.filter(F.col(found).getField("at"), lambda p: p <= F.col(upto) - K))
    rows = rows.withColumn("before", whole("anchors", "stay")).withColumn("after", whole("next_anchors", "come"))
    first = F.greatest(F.lit(0), F.col("stay") - (K - 1))
    around = F.substring(F.col("edited_text").cast("binary"), first + 1, F.least(F.col("stay"), F.lit(K - 1)) + (K - 1))
    moved = lambda found, by: F.transform(found, lambda a: F.struct((a.at + by).alias("at"), a.hash.alias("hash")))
    part = lambda xs, a, n: F.slice(xs, a, F.greatest(F.lit(0), n))
    last, next_one = part("anchors", F.greatest(F.lit(1), F.col("before")), F.least(F.col("before"), F.lit(1))), part("next_anchors", F.lit(1), F.least(F.col("after"), F.lit(1)))
    rows = rows.withColumn("_across", short_anchors(around)).withColumn("_across", F.concat(last, moved(F.col("_across"), first), moved(next_one, F.col("stay"))))
    rows = rows.withColumn("_seam", marks(F.col("_across")))
    # the first whole anchor after the seam is followed by others, the last of them by none
    seam = F.when(F.col("after") > 0, part("_seam", F.lit(1), F.size("_seam") - 1)).otherwise(F.col("_seam"))
    tail = F.transform(part("next_anchors", F.greatest(F.lit(1), F.col("after")), F.least(F.col("after"), F.lit(1))), lambda a: F.xxhash64(a.hash, F.lit(-1)))
    edited = F.concat(part("marks", F.lit(1), F.col("before") - 1), seam, part("next_marks", F.lit(1), F.col("after") - 1), tail)
    rows = rows.withColumn("edited_marks", edited)
    for name in ("", "next_", "edited_"):
        rows = rows.withColumn(f"{name}marks", _or_whole(F.col(f"{name}marks"), F.col(f"{name}text")))
    return rows.select("doc_id", "n_chars", "edited_text", fingerprint(F.col("marks")).alias("fingerprint"), fingerprint(F.col("edited_marks")).alias("edited_fingerprint"), likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op5_syncmers": op5_syncmers}
SQL: dict[str, str] = {}
