"""Operator 9: substring dedup by prefix-partitioned suffix trees over words.

A suffix starts at each word, and suffixes are compared word by word, on the words themselves. What
decides is whether two of them share ``window`` words, so subtrees are cut at that depth: a deep
internal node is a run of suffixes, in suffix order, with a longest common prefix of ``window`` words
or more between neighbours. Below a node with leaves in two or more documents lies a part of a
maximal repeat: the leaves outside the smallest document id are repeats, and the runs of words that
they cover are removed.

The order comes from prefix doubling: words get exact numbers (by a hash, then confirmed byte by
byte), and ranks of 1, 2, 4 and 8 words give those of a whole window. Equal ranks are equal words.
Suffixes whose window hash is alone in their group are leaves of their own and are pruned before.

Suffixes are dealt into memory-sized groups by a variable-length prefix: the least-hashed run of 2
words in the window, or of 4, 8 or all of them where a first pass over all documents finds the
shorter ones too frequent. Suffixes next to each other mostly share that run, so they travel
together as one stretch of text, about three words a suffix instead of ``window``. A group that is
still too large for memory is ordered in several passes, each over the suffixes of one residue of
the hash of their window.

Skew: before the shuffle each slice of input (about 8 MB) orders its own suffixes and keeps, of the
leaves below one node, only those of its smallest document; the others are repeats already. So a
window that stands in a third of all documents reaches its group once a slice. Repeats travel as
packed arrays by document bucket.

Defined results: null or empty texts have no words; a row with a null id keeps all words and
removes nothing elsewhere; rows with one id are one document (a window that stands in two of their
texts is no repeat; each text loses what smaller ids have, at the places found in any of them);
texts shorter than the window lose nothing; an empty table gives no rows; other columns of the input
are ignored. The id column must be of an integer type.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import tokens as T
from ledgerline.llm.common import in_small_batches, integer_id, table

WINDOW = 13
SLICE = 8 << 20
#: Bytes of input text whose suffixes a group holds, and of stretches (about three times as long) that are ordered at once.
TASK_BYTES, ORDER_BYTES = 4 << 20, 32 << 20
#: Prefixes are lengthened from this share of all suffixes on, or a thirty-second of a group's: so many at most a level.
LEAST_SHARE = 1 / 65536
#: Document buckets: pmod(id, PRIME) * SPREAD % PRIME, the same in numpy and in SQL.
PRIME, SPREAD = 2147483647, 48271
U = np.uint64
_ZSTD = pa.Codec("zstd", compression_level=3)


def prefix_lengths(window: int) -> list[int]:
    """Words in a prefix: 2, 4, 8 and so on, then the whole window."""
    return [n for k in range(1, 30) if (n := 2**k) < window] + [window]


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray | None = None, block: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words, equal for equal bytes and only for them; and the 64-bit hashes that were confirmed."""
    names = T.hashes(data, starts, ends) if names is None else names
    _, first, ids = np.unique(names, return_index=True, return_inverse=True)
    lead = first[ids]
    size = ends - starts
    same = bool((size == size[lead]).all())
    for a in range(0, len(starts) if same else 0, block):
        n = size[a : a + block]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not (data[at + np.repeat(starts[a : a + block], n)] == data[at + np.repeat(starts[lead[a : a + block]], n)]).all():
            same = False
            break
    if not same:  # two words share a hash
        raw, numbers = data.tobytes(), {}
        ids = np.array([numbers.setdefault(raw[s:e], len(numbers)) for s, e in zip(starts.tolist(), ends.tolist())], np.int64)
    return ids, names


def window_ranks(ids: np.ndarray, whole: np.ndarray, window: int) -> np.ndarray:
    """Ranks, in suffix order, of the windows that start at ``whole``: equal where all ``window`` words are."""

    def pairs(rank, size, total, at):
        """Ranks of ``total`` words from those of ``size``, at the given places."""
        return np.unique(rank[at] * (int(rank.max()) + 1) + rank[at + total - size], return_inverse=True)[1]

    rank, size = ids.astype(np.int64), 1
    if not len(whole):
        return whole
    while 2 * size < window:
        rank, size = pairs(rank, size, 2 * size, np.arange(len(ids) - 2 * size + 1)), 2 * size
    return pairs(rank, size, window, whole) if size < window else np.unique(rank[whole], return_inverse=True)[1]


def deep_nodes(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each leaf, the smallest document below its deep node."""
    least = np.full(int(rank.max()) + 1 if len(rank) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, rank, doc)
    return least[rank]


def repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray, whole: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Whether each window that starts at ``whole`` stands in a smaller document, too.

    A window whose hash is alone, or in one document only, is a leaf below no deep node and is pruned; the others are
    put in suffix order on the words themselves.
    """
    later = np.zeros(len(whole), bool)
    if len(whole) < 2:
        return later
    h = T.window_hashes(names, window)[whole]
    order = np.argsort(h)
    first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    n = np.diff(first, append=len(h))
    own = doc[order]
    two = np.repeat(np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first), n)
    if not two.any():
        return later
    some = np.sort(order[two])
    at = whole[some]
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    held = np.cumsum(edge[:-1]) > 0  # words of these windows; each window stays in one piece
    place = np.cumsum(held) - 1
    ids, _ = word_ids(data, starts[held], ends[held], names[held])
    later[some] = doc[some] > deep_nodes(window_ranks(ids, place[at], window), doc[some])
    return later


def _parsed(column: pa.Array, window: int):
    """Bytes, word starts and ends, first word of each row (one more), starts of whole windows, row of each word."""
    data, offsets = T.text_bytes(column)
    starts, ends, row = T.words(data, offsets)
    n = len(row) - window + 1
    whole = np.flatnonzero(row[:n] == row[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
    return data, starts, ends, np.searchsorted(row, np.arange(len(column) + 1)), whole, row


def _frequent(window: int, share: float):
    """Runs of words with that share of a slice's suffixes, level by level, and the number of suffixes at level 0."""

    def run(batches):
        for batch in T.slices(batches, SLICE):
            data, starts, ends, _, whole, _ = _parsed(batch.column("text"), window)
            out, names, at = [(0, 0, len(whole))], T.hashes(data, starts, ends), whole
            for size in prefix_lengths(window)[:-1]:
                key = T.window_hashes(names, size)[at]
                values, counts = np.unique(key, return_counts=True)
                hit = counts >= max(2, share * len(whole))
                out += [(size, int(v), int(c)) for v, c in zip(values[hit].view(np.int64), counts[hit])]
                at = at[np.isin(key, values[hit])]
                if not len(at):
                    break
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["size", "prefix", "n"])

    return run


def _sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours."""
    size = 1
    while 2 * size <= n:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def _keys(names: np.ndarray, at: np.ndarray, frequent: dict[int, np.ndarray], window: int) -> np.ndarray:
    """The group key of the windows at the given places: of their words alone."""
    key, open_ = np.zeros(len(at), U), np.ones(len(at), bool)
    top = U(1 << 63)
    for size in prefix_lengths(window):
        if not open_.any():
            break
        h = T.window_hashes(names, size)
        rare = T.mix64(h + U(size)) & ~top
        if size < window:
            rare[np.isin(h, frequent[size])] |= top
        got = _sliding_least(rare, window - size + 1)[at]
        take = open_ & ((got & top == 0) | (size == window))
        key[take] = got[take]
        open_ &= ~take
    return key


def _stretches(at: np.ndarray, group: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First window, and words, of the runs of neighbouring windows of one row and group; ``at`` is sorted."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(at)) + window - 1


def _pack(ids: np.ndarray, place: np.ndarray, texts: list[bytes]) -> bytes:
    """Stretches of a group: document ids, places in the document, texts."""
    body = b"".join(texts)
    head = np.concatenate([np.diff(ids, prepend=0), place, np.array([len(t) for t in texts])]).astype("<i8")
    planes = np.ascontiguousarray(head.view(np.uint8).reshape(-1, 8).T).tobytes()
    both = _ZSTD.compress(planes + body, asbytes=True)
    return np.array([len(ids), len(body)], "<u4").tobytes() + both


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    n, size = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    raw = pa.decompress(memoryview(blob)[8:], decompressed_size=24 * n + size, codec="zstd", asbytes=True)
    head = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 24 * n).reshape(8, -1).T).view("<i8").ravel()
    ends = np.concatenate([[0], np.cumsum(head[2 * n :])]).astype("<i4")
    return np.cumsum(head[:n]), head[n : 2 * n], pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw[24 * n :])])


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (np.mod(ids, PRIME) * SPREAD % PRIME % buckets).astype(np.int32)


def _marks(ids: np.ndarray, at: np.ndarray, buckets: int):
    """(bucket, blob) of repeats: ids and places, sorted, as differences."""
    bucket = _bucket(ids, buckets)
    order = np.lexsort((at, ids, bucket))
    bucket, ids, at = bucket[order], ids[order], at[order]
    for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(bucket)) + 1) if len(ids) else []:
        both = np.concatenate([np.diff(ids[part], prepend=0), at[part]]).astype("<i8")
        planes = np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T)
        yield int(bucket[part[0]]), zlib.compress(planes.tobytes(), 1)


def _unmarks(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(raw.T).view("<i8").ravel()
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


_OUT = pa.schema([("part", pa.int32()), ("marks", pa.bool_()), ("blob", pa.binary())])


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _OUT)] if rows else [pa.array([], f.type) for f in _OUT], schema=_OUT)


def _deal(window: int, frequent: dict[int, np.ndarray], parts: int, buckets: int):
    """Suffixes to the groups of their prefixes, as stretches; repeats inside a slice to document buckets."""

    def run(batches):
        for batch in T.slices(batches, SLICE):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            data, starts, ends, first, whole, row = _parsed(batch.column("text"), window)
            if not len(whole):
                continue
            names, doc = T.hashes(data, starts, ends), ids[row[whole]]
            later = repeats(data, starts, ends, names, whole, doc, window)
            if later.any():
                place = whole[later] - first[row[whole[later]]]
                yield _rows([(b, True, x) for b, x in _marks(doc[later], place, buckets)])
            at = whole[~later]
            part = (_keys(names, at, frequent, window) % U(parts)).astype(np.int64)
            lead, size = _stretches(at, part, row, window)
            begin, raw = at[lead], data.tobytes()
            group, owner, place = part[lead], ids[row[begin]], begin - first[row[begin]]
            a, z = starts[begin], ends[begin + size - 1]
            order = np.lexsort((place, owner, group))
            out = []
            for run_ in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                out.append((int(group[run_[0]]), False, _pack(owner[run_], place[run_], [raw[i:j] for i, j in zip(a[run_].tolist(), z[run_].tolist())])))
                if len(out) == 500:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return run


def _found(held: list[tuple[np.ndarray, np.ndarray, pa.Array]], window: int, residue: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, np.ndarray]:
    """Documents and places of the repeats among the suffixes of the stretches held, or of one residue of their windows."""
    ids, place = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    data, starts, ends, first, whole, row = _parsed(pa.concat_arrays([h[2] for h in held]), window)
    names = T.hashes(data, starts, ends)
    if residue[1] > 1:
        whole = whole[T.window_hashes(names, window)[whole] % U(residue[1]) == residue[0]]
    at = row[whole]
    doc, where = ids[at], place[at] + whole - first[at]
    later = repeats(data, starts, ends, names, whole, doc, window)
    return doc[later], where[later]


def _subtrees(window: int, buckets: int, order_bytes: int):
    """Of all suffixes of the groups in this task: repeats below the nodes at the window's depth."""

    def run(batches):
        kept: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, done, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if done:
                    yield _rows([(part, True, blob)])
                else:
                    kept.setdefault(part, []).append(blob)
        for part in list(kept):
            blobs = kept.pop(part)
            size = sum(int(np.frombuffer(b, "<u4", 2)[1]) for b in blobs)
            passes = -(-size // order_bytes)
            for k in range(passes):
                held = []
                for blob in blobs:
                    one = _unpack(blob)
                    held.append(one if passes == 1 else _narrowed(one, window, (k, passes)))
                doc, place = _found([h for h in held if len(h[0])] or held[:1], window, (k, passes))
                if len(doc):
                    yield _rows([(b, True, x) for b, x in _marks(doc, place, buckets)])

    return run


def _narrowed(one: tuple[np.ndarray, np.ndarray, pa.Array], window: int, residue: tuple[int, int]):
    """The shorter stretches that hold the windows of one residue."""
    ids, place, texts = one
    data, starts, ends, first, whole, row = _parsed(texts, window)
    at = whole[T.window_hashes(T.hashes(data, starts, ends), window)[whole] % U(residue[1]) == residue[0]]
    lead, size = _stretches(at, np.zeros(len(at), np.int64), row, window)
    begin, raw = at[lead], data.tobytes()
    parts = [raw[a:z] for a, z in zip(starts[begin].tolist(), ends[begin + size - 1].tolist())]
    return ids[row[begin]], place[row[begin]] + begin - first[row[begin]], pa.array(parts, pa.binary())


def _cut(window: int):
    """Marks of a bucket, then its documents: what is left of each."""

    def run(batches):
        bucket, blobs, got = None, [], None
        for batch in batches:
            out = []
            b, ids, texts, marks = (batch.column(i).to_pylist() for i in range(4))
            for b, i, text, mark in zip(b, ids, texts, marks):
                if b != bucket:
                    bucket, blobs, got = b, [], None
                if mark is not None:
                    blobs.append(mark)
                    continue
                if got is None:
                    pairs = [_unmarks(x) for x in blobs]
                    doc, at = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
                    order = np.argsort(doc, kind="stable")
                    got, blobs = (doc[order], at[order]), []
                words = (text or "").encode().split()
                a, z = np.searchsorted(got[0], [i, i + 1]) if i is not None else (0, 0)
                spans = []
                if a < z:
                    here = np.sort(got[1][a:z])
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, here, 1)
                    np.add.at(cover, np.minimum(here + window, len(words)), -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                    spans = [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    kept = words
                out.append((i, len(words), len(words) - len(kept), spans, b" ".join(kept).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _CUT)], schema=_CUT)

    return run


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_CUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", _SPAN), ("kept_text", pa.string())])


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, task_bytes: int = TASK_BYTES, order_bytes: int = ORDER_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, removed (array of struct<start, end>, in words), kept_text."""
    docs = in_small_batches(docs).select(integer_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    usable = docs.where("doc_id is not null and text is not null")
    parts = max(8, -(-(usable.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // task_bytes))
    share = max(1 / (32 * parts), LEAST_SHARE)
    found = usable.mapInArrow(_frequent(window, share), "size long, prefix long, n long").groupBy("size", "prefix").agg(F.sum("n").alias("n"))
    total = F.sum(F.when(F.col("size") == 0, F.col("n"))).over(Window.partitionBy())
    found = found.withColumn("total", total).where((F.col("size") > 0) & (F.col("n") >= F.col("total") * share)).collect()  # 1 / share a level at most
    frequent = {k: np.sort(np.array([r.prefix for r in found if r["size"] == k], np.int64).view(U)) for k in prefix_lengths(window)[:-1]}
    kind = "part int, marks boolean, blob binary"
    dealt = usable.mapInArrow(_deal(window, frequent, parts, parts), kind).repartitionById(parts, F.col("part"))
    marks = dealt.mapInArrow(_subtrees(window, parts, order_bytes), kind)
    marks = marks.select(F.col("part").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.col("blob").alias("mark"))
    bucket = F.coalesce((F.pmod("doc_id", F.lit(PRIME)) * SPREAD) % PRIME % parts, F.lit(0)).cast("int")
    rows = marks.unionByName(docs.select(bucket.alias("bucket"), "doc_id", "text", F.lit(None).cast("binary").alias("mark")))
    rows = rows.repartitionById(parts, F.col("bucket")).sortWithinPartitions(F.col("mark").isNull())
    return rows.mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op9_substrings": op9_substrings}
SQL = {
    "op9_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w WHERE len(words) >= 13),
s AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS win FROM p),
r AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY win) AS rep FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM r WHERE rep),
g AS (SELECT doc_id, list(k) AS ks, count(*) AS n FROM c GROUP BY doc_id),
k AS (SELECT w.doc_id, w.words, coalesce(g.ks, []) AS ks, coalesce(g.n, 0) AS n FROM w LEFT JOIN g USING (doc_id)),
e AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
t AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS kept FROM e ANTI JOIN c ON e.doc_id = c.doc_id AND e.i = c.k GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN t USING (doc_id)
""",
}
