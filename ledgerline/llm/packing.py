"""Operator 7: best-fit packing of tokenized documents by exact-complement hashing.

Tokens: byte-level BPE by the tokenizers library. The text is cut into pre-tokens with numpy by
the tokenizer's own pattern; each distinct pre-token of a slice is given to the tokenizer's model
once, and texts with a character from U+0250 on go to the tokenizer whole, so ids equal those of
``encode``. Special tokens' strings in a text are ordinary text.

A document is its ids and an end id. One longer than ``capacity`` is cut into full pieces, the
first of which may be shorter. Packing needs only how many pieces have each length: from the
longest down, a length's gap is filled exactly by one available length, then by two, then by
three, found by their sums; as many sequences as the counts allow take that combination. What has
no exact complement is packed best-fit, longest first. The plan's size depends on the capacity, not
on the corpus. Pieces take their places by rank within their length; ranks are counted in two
levels, so a length that many documents share is spread over many tasks.

Defined results: null and empty texts are the end id alone; repeated rows are packed as often as
they occur; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import tokens as T
from ledgerline.llm.common import in_small_batches, stored, table

CAPACITY, END_ID = 1024, 2
SLICE = 4 << 20
CACHE = 400_000
BUCKETS = 256
VOCABULARY = "byte_bpe_50k.json"
LATIN = 0x250
_CLASS = np.array([0 if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(LATIN)] + [3], np.uint8)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> list[str]:
    """The printable character that byte-level BPE writes for each byte: itself, or the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class Encoder:
    """Ids of many texts at once; keeps the ids of pre-tokens it has met, at most ``CACHE`` of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.names = _byte_names()
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids: list[np.ndarray] = []

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the pre-tokens of texts that have no character from U+0250 on."""
        code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        row = np.searchsorted(at, offsets)
        n = len(code)
        if not n:
            return at[:0], at[:0]
        kind = _CLASS[np.minimum(code, LATIN)]
        first = np.zeros(n + 1, bool)
        first[row] = True
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start[1:] &= (kind[1:] == 0) | (code[:-1] != 32)  # a space joins what follows it
        space_end = np.zeros(n, bool)
        space_end[:-1] = (kind[:-1] == 0) & (kind[1:] != 0) & ~first[1:n]
        start = start | space_end | first[:n]
        # 's 't 'm 'd 're 've 'll after a token's end
        quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == 1) & ~first[1:n])
        if len(quote):
            c1 = code[quote + 1]
            c2 = np.where((quote + 2 < n) & ~first[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
            one = np.isin(c1, [ord(c) for c in "stmd"])
            two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
            for hit, size in ((one, 1), (two & ~one, 2)):
                q = quote[hit]
                start[q + 1] = False
                after = q + 1 + size
                start[after[after < n]] = True
        begin = np.flatnonzero(start)
        return at[begin], at[np.append(begin[1:], n)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the first of each text (one more)."""
        data, offsets = T.text_bytes(column)
        n_rows = len(offsets) - 1
        # lead bytes from 0xC9 0x90 on: a character from U+0250 on
        high = np.flatnonzero((data > 0xC9) | ((data == 0xC9) & (np.append(data[1:], 0) >= 0x90)))
        odd = np.unique(np.searchsorted(offsets[1:], high, "right"))
        if len(odd):
            texts = column.to_pylist()
            if len(odd) == n_rows:
                parts = [np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts]
                return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
            plain = pa.array(["" if i in set(odd.tolist()) else t for i, t in enumerate(texts)], pa.large_string())
            ids, first = self.encode(plain)
            parts = np.split(ids, first[1:-1])
            for i in odd:
                parts[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        starts, ends = self.pieces(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(n_rows + 1, np.int64)
        _, where, which = np.unique(h := T.hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(where) > CACHE:
            self.clear()
        raw, model, names = data.tobytes(), self.whole.model, self.names
        slot = np.empty(len(where), np.int64)
        for k, (key, a, z) in enumerate(zip(h[where].tolist(), starts[where].tolist(), ends[where].tolist())):
            i = self.known.get(key)
            if i is None:
                i = self.known[key] = len(self.ids)
                self.ids.append([t.id for t in model.tokenize("".join([names[b] for b in raw[a:z]]))])
            slot[k] = i
        chosen = [self.ids[i] for i in slot.tolist()]
        size = np.fromiter(map(len, chosen), np.int64, len(chosen))
        flat = np.fromiter((x for ids in chosen for x in ids), np.uint32, int(size.sum()))
        begin = np.cumsum(size) - size
        n = size[which]
        end = np.cumsum(n)
        ids = flat[np.arange(end[-1]) - np.repeat(end - n, n) + np.repeat(begin[which], n)]
        return ids, np.append(0, end)[np.searchsorted(starts, offsets)]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def piece_table(docs: DataFrame, *, text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    path = vocabulary or vocabulary_path()

    def run(batches):
        for batch in T.slices(batches, SLICE):
            ids, first = encoder(path).encode(batch.column("text"))
            rows = []
            for doc_id, a, z in zip(batch.column("doc_id").to_pylist(), first, first[1:]):
                own = np.append(ids[a:z], end_id).astype("<u4")
                n = len(own)
                cuts = [0, *range(n % capacity or capacity, n, capacity), n] if n > capacity else [0, n]
                rows += [(doc_id, i, s, e - s, zlib.crc32(own[s:e].tobytes())) for i, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            doc, i, s, n, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(doc, batch.schema.field("doc_id").type), pa.array(i, pa.int32()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_small_batches(docs).select("doc_id", F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _exact(left: np.ndarray, capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences filled exactly by a length and up to ``most`` more, taken out of ``left``: all singles, then pairs, then triples."""
    out: list[tuple[tuple[int, ...], int]] = []

    def fits(lengths: tuple[int, ...]) -> bool:
        return all(left[n] >= lengths.count(n) for n in lengths)

    def sum_of(total: int, parts: int, largest: int, held: tuple[int, ...]) -> tuple[int, ...] | None:
        """Available lengths with that sum, the largest first, beside those held."""
        if parts == 1:
            return (total,) if 0 < total <= largest and fits((*held, total)) else None
        x = np.arange(min(largest, total - parts + 1), -(-total // parts) - 1, -1)
        x = x[left[x] > 0]
        if parts == 2:
            x = x[left[total - x] > 0]
        for n in x.tolist():
            if fits((*held, n)) and (more := sum_of(total - n, parts - 1, n, (*held, n))):
                return (n, *more)
        return None

    if left[capacity]:
        out.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for parts in range(1, most + 1):
        for n in range(capacity - 1, 0, -1):
            while left[n] and (more := sum_of(capacity - n, parts, n, (n,))):
                lengths = (n, *more)
                used = {k: lengths.count(k) for k in lengths}
                times = min(int(left[k]) // c for k, c in used.items())
                out.append((lengths, times))
                for k, c in used.items():
                    left[k] -= times * c
    return out


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the open sequence with the least room for it; equal open sequences are one class."""
    open_: dict[tuple[int, ...], int] = {}
    by_gap: dict[int, list[tuple[int, ...]]] = {}

    def put(lengths, times):
        if lengths not in open_:
            open_[lengths] = 0
            by_gap.setdefault(capacity - sum(lengths), []).append(lengths)
        open_[lengths] += times

    for n in range(capacity, 0, -1):
        c = int(left[n])
        while c:
            gap = next((g for g in range(n, capacity) if by_gap.get(g)), None)
            if gap is None:
                each = capacity // n
                if c >= each:
                    put((n,) * each, c // each)
                if c % each:
                    put((n,) * (c % each), 1)
                break
            lengths = by_gap[gap][-1]
            times = min(c, open_[lengths])
            c -= times
            if times == open_[lengths]:
                del open_[lengths]
                by_gap[gap].pop()
            else:
                open_[lengths] -= times
            put((*lengths, n), times)
    return list(open_.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences), for so many pieces of each length.

    Exact complements of up to three, two, one or no lengths first; the plan with the fewest sequences is kept.
    """
    plans = []
    for most in (3, 2, 1, 0):
        left = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            left[n] = c
        plans.append(_exact(left, capacity, most) + _best_fit(left, capacity))
    return min(plans, key=lambda p: sum(times for _, times in p))


def _places(found: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Sorted rows (length, first rank, first sequence, offset) of the places of each length."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in found:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, *, text_col: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(piece_table(docs, text_col=text_col, vocabulary=vocabulary, capacity=capacity, end_id=end_id).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int")))
    counts = pieces.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    places = _places(plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity))  # capacity rows at most
    upto = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("_rank", inside).join(before, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("_rank"))
    shared = docs.sparkSession.sparkContext.broadcast(places)  # its size depends on the capacity alone

    def run(batches):
        at = shared.value
        keys = at[:, 0] << 44 | at[:, 1] if len(at) else np.zeros(0, np.int64)
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            k = np.searchsorted(keys, batch.column("length").to_numpy() << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at[k, 2] + rank - at[k, 1]), pa.array(at[k, 3])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
SQL: dict[str, str] = {}
