"""Operator 2: near-duplicates by b-bit MinHash, confirmed on full shingle sets.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set is its
distinct 5-word shingles (with fewer words, the whole sequence). Per document: ``HASHES`` minima,
of which bands of ``ROWS`` give bucket keys and ``B`` bits each are packed into a signature.

1. Equal sets (by a 128-bit hash) become one class; only its least id goes on.
2. In each bucket the signatures' equal ``B``-bit fields, counted with bit operations and corrected
   for chance, estimate similarities. Pairs from ``FLOOR`` on (six standard deviations below the
   threshold) make a graph; of each set that it joins, a star of edges to the least id leaves the
   task: no group is expanded into rows of pairs, the rows do not depend on the order in which
   members arrive, and the bands of one group give mostly equal edges. The components of all stars
   are supergroups: every link lies inside one.
3. Inside a supergroup all pairs from ``FLOOR`` on, but those already joined, are confirmed on the
   full sets; again stars leave the task. Their components are the result.

Large buckets and supergroups are cut into blocks of bounded size; each pair of blocks is a task.

A pair at the threshold shares no band with a chance of (1 - 0.75 ** 3) ** 42, about 1e-10.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; a
row with a null id is a class of its own, with a null component, and is kept; rows that repeat an
id share one component, whatever their texts (each text keeps its own set and its own links; an
empty one has none); an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import tokens as T
from ledgerline.llm.common import in_small_batches, integer_id, stored, table
from ledgerline.operators.components import components

SHINGLE = 5
HASHES, ROWS, B = 128, 3, 4
BANDS = HASHES // ROWS
FLOOR = 0.5
THRESHOLD = (75, 100)
SLICE = 2 << 20
#: Members of a block of a bucket; members and shingles of a block of a supergroup.
BLOCK, BLOCK_SHINGLES = 2048, 500_000
U = np.uint64
_MULTIPLY = T.mix64(np.arange(1, HASHES + 1, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)
_ADD = T.mix64(np.arange(1, HASHES + 1, dtype=U) * U(0xA0761D6478BD642F))


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row; first of each row (one more)."""
    data, offsets = T.text_bytes(column)
    data = T.lower_ascii(data)
    starts, ends, row = T.words(data, offsets)
    n_rows = len(offsets) - 1
    names = T.hashes(data, starts, ends)
    n = np.bincount(row, minlength=n_rows)
    last = len(row) - size + 1
    whole = np.flatnonzero(row[:last] == row[size - 1 :]) if last > 0 else np.zeros(0, np.int64)
    h, at = T.window_hashes(names, size)[whole], row[whole]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        first = np.searchsorted(row, few)
        short = np.array([T.window_hashes(names[a : a + k], k)[0] for a, k in zip(first.tolist(), n[few].tolist())], U)
        h, at = np.concatenate([h, T.mix64(short + n[few].astype(U))]), np.concatenate([at, few])
    order = np.lexsort((h, at))
    h, at = h[order], at[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    h, at = h[new], at[new]
    return h, np.searchsorted(at, np.arange(n_rows + 1))


def _minima(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint64 [HASHES, rows]; rows without shingles have the largest number."""
    out = np.full((HASHES, len(first) - 1), ~U(0), U)
    some = np.flatnonzero(np.diff(first))
    # blocks of rows, small enough for the cache
    step = 0
    while step < len(some):
        stop = max(step + 1, int(np.searchsorted(first[some + 1], first[some[step]] + (1 << 15), "right")))
        rows = some[step:stop]
        part = h[first[rows[0]] : first[rows[-1] + 1]]
        begin = first[rows] - first[rows[0]]
        for k in range(HASHES):
            out[k, rows] = np.minimum.reduceat(part * _MULTIPLY[k] + _ADD[k], begin)
        step = stop
    return out


def _signed(batches):
    for batch in T.slices(batches, SLICE):
        h, first = shingles(batch.column("text"))
        n = np.diff(first)
        sums = np.zeros((2, len(n)), U)
        some = np.flatnonzero(n)
        if len(some):
            sums[0, some] = np.add.reduceat(T.mix64(h + U(1)), first[some])
            sums[1, some] = np.add.reduceat(T.mix64(h ^ U(0x5851F42D4C957F2D)), first[some])
        low = _minima(h, first)
        field = (T.mix64(low) >> U(64 - B)).astype(U)
        per = 64 // B
        words = np.zeros((HASHES // per, len(n)), U)
        for k in range(HASHES):
            words[k // per] |= field[k] << U(B * (k % per))
        bands = np.zeros((BANDS, len(n)), U)
        for k in range(BANDS):
            bands[k] = T.mix64(low[3 * k] + T.mix64(low[3 * k + 1] + T.mix64(low[3 * k + 2] + U(k))))
        lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x.T).view(np.int64).ravel()), len(x)).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists(words), lists(bands)], names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "sig", "bands"])


def signatures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a and set_b (hashes of the set), sig (packed fields), bands (bucket keys)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(integer_id(docs, id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(_signed, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, sig array<long>, bands array<long>")


def _equal(sig: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated similarity of a signature to others, from the count of equal fields."""
    d = sig ^ one
    d |= d >> U(1)
    d |= d >> U(2)  # folds the B = 4 bits of a field into its lowest
    n = np.bitwise_count(d & U(sum(1 << (B * k) for k in range(64 // B)))).sum(1)
    return ((1 - n / HASHES) - 2.0**-B) / (1 - 2.0**-B)


class _Joined:
    """Sets of members that are joined so far, by position."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.label, self.any = ids, np.arange(len(ids)), False

    def join(self, a: int, others: np.ndarray) -> None:
        if len(others):
            self.any = True
            near = np.unique(self.label[np.append(others, a)])
            self.label[np.isin(self.label, near)] = near[0]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(least id of a set, another of its ids)."""
        if not self.any:
            return self.ids[:0], self.ids[:0]
        _, at = np.unique(self.label, return_inverse=True)
        least = np.full(at.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, at, self.ids)
        keep = least[at] != self.ids
        return least[at][keep], self.ids[keep]


def _sides(side: np.ndarray):
    """Positions of either block (side 2: a block against itself)."""
    return np.flatnonzero(side != 1), np.flatnonzero(side != 0)


def _likely(batches):
    """Rows (key, x, y, side, doc_id, sig), sorted: stars of the sets that likely pairs join in each group."""
    out, twos, n = [], [], 0
    for _, held in T.groups(batches, 3):
        side, ids = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in ("side", "doc_id"))
        sig = np.concatenate([b.column("sig").flatten().to_numpy() for b in held]).reshape(len(ids), -1).view(U)
        if len(ids) == 2:  # most groups: compared many at a time
            if side[0] == 2 or side[0] != side[1]:
                twos.append((ids, sig))
                n += 1
        else:
            x, y = _sides(side)
            joined = _Joined(ids)
            for a in x.tolist():
                other = y[joined.label[y] != joined.label[a]]
                if len(other):
                    joined.join(a, other[_equal(sig[other], sig[a]) >= FLOOR])
            out.append(joined.stars())
            n += len(out[-1][0])
        if n > 10_000:
            yield _pairs([*out, _alike(twos)])
            out, twos, n = [], [], 0
    if n:
        yield _pairs([*out, _alike(twos)])


def _alike(twos) -> tuple[np.ndarray, np.ndarray]:
    """The likely ones of many pairs, as stars."""
    if not twos:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, sig = np.array([i for i, _ in twos]), np.array([s for _, s in twos])
    near = _equal(sig[:, 0], sig[:, 1]) >= FLOOR
    return ids[near].min(1), ids[near].max(1)


def _confirmed(batches):
    """Rows (group, x, y, side, doc_id, sig, text), sorted: stars of the sets that links on full sets join in each group."""
    low, high = THRESHOLD
    for _, held in T.groups(batches, 3):
        side, ids = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in ("side", "doc_id"))
        sig = np.concatenate([b.column("sig").flatten().to_numpy() for b in held]).reshape(len(ids), -1).view(U)
        sets = [shingles(b.column("text")) for b in held]
        size = np.concatenate([np.diff(f) for _, f in sets])
        _, number = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True)
        end = np.cumsum(size)
        x, y = _sides(side)
        joined, mark = _Joined(ids), np.zeros(len(number), bool)
        for a in x.tolist():
            other = y[joined.label[y] != joined.label[a]]
            if len(other):
                other = other[_equal(sig[other], sig[a]) >= FLOOR]
            if not len(other):
                continue
            own = number[end[a] - size[a] : end[a]]
            mark[own] = True
            n = size[other]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(end[other] - n, n)
            both = np.add.reduceat(mark[number[at]].astype(np.int64), np.cumsum(n) - n)
            mark[own] = False
            joined.join(a, other[high * both >= low * (size[a] + n - both)])
        yield _pairs([joined.stars()])


def _pairs(stars) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in stars]), pa.int64()) for k in (0, 1)], names=["a", "b"])


def _block_pairs(rows: DataFrame, group: str, blocks: Column, *columns: str) -> DataFrame:
    """Rows of each group dealt into ``blocks`` blocks; every pair of blocks of a group stands together, sorted."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    rows = rows.select(group, F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"), "doc_id", *columns)
    return rows.repartition(group, "x", "y").sortWithinPartitions(group, "x", "y", "doc_id")


def near_dups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    docs = in_small_batches(docs).select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(signatures(docs))
    same, row = ["n_shingles", "set_a", "set_b"], ["doc_id", "text_hash"]
    first = F.min(F.struct(*row)).alias("first")
    classes = stored(signed.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(first).select(*same, F.col("first.doc_id").alias("class_id"), "first.text_hash"))
    reps = signed.join(classes.select(F.col("class_id").alias("doc_id"), "text_hash"), row, "left_semi").dropDuplicates(row)
    rows = reps.select(*row, F.explode("bands").alias("key"))
    keys = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(keys, "key").join(reps.select(*row, "sig"), row)
    likely = _block_pairs(shared, "key", F.ceil(F.col("n") / BLOCK), "sig").mapInArrow(_likely, "a long, b long")
    groups = components(likely).toDF("doc_id", "group")
    members = stored(groups.join(reps.select(*row, "sig", "n_shingles"), "doc_id"))
    sizes = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("n"))
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(members.join(sizes, "group").select(*row, "group", "sig", "n"), row).dropDuplicates(row)
    links = _block_pairs(texts, "group", F.col("n"), "sig", "text").mapInArrow(_confirmed, "a long, b long")
    classed = stored(signed.select("doc_id", *same).join(classes.drop("text_hash"), same, "left"))
    # rows that repeat an id with other texts join the classes of all of them
    many = classed.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("_b")).where("a < _b").drop("_b")
    again = classed.join(many, "doc_id").select("a", F.col("class_id").alias("b")).where("b is not null")
    out = classed.join(components(links.unionByName(again)).toDF("class_id", "comp"), "class_id", "left")
    comp = F.coalesce("comp", "class_id", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), comp).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == comp).otherwise(F.lit(True)).alias("kept"))


def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"))


QUERIES = {"op2_near_dups": op2_near_dups}
SQL: dict[str, str] = {}
