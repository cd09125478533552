"""Operator 1: quality by random indexing and a small network.

Tokens are runs of letters and digits and runs of other characters. Each token falls into one
of ``1 << BITS`` buckets. A bucket has a sparse random index vector (four entries of +1 or -1,
from a hash) and a context vector: the sum of the index vectors of its neighbours, two to either
side, over all documents. Context vectors, less their frequency-weighted mean and scaled to unit
length, are the word vectors. The table has a fixed size, whatever the corpus.

A document is the mean of its word vectors. A network of two layers in numpy, fitted on a
bounded sample of labelled documents, gives logits; a temperature, fitted on a fold that the
network did not see, turns them into calibrated probabilities.

Defined results: null and empty texts are the zero vector and get its score; equal texts have
equal scores; without labelled rows of both kinds every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import tokens as T
from ledgerline.llm.common import in_small_batches, table
from ledgerline.llm.labelled import MAX_LABELLED, held_out, training_sample

BITS, DIMS, ENTRIES, WINDOW = 15, 32, 4, 2
BLOCKS, SALTS = 16, 8
HIDDEN, STEPS, SEED = 24, 600, 11
SLICE = 1 << 20
U = np.uint64
_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 others
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def token_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens; first token of each row (one more)."""
    data, offsets = T.text_bytes(column)
    kind = _KIND[data]
    a, b = T.runs(kind == 1, offsets), T.runs(kind == 2, offsets)
    starts, ends = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return (T.hashes(data, starts, ends) & U((1 << BITS) - 1)).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket."""
    h = T.mix64(np.arange((1 << BITS) * ENTRIES, dtype=U) + U(1 << 40)).reshape(-1, ENTRIES)
    return (h % U(DIMS)).astype(np.int64), np.where(h >> U(63), 1, -1)


def _contexts(batches):
    """Sums of a task: one row a block of buckets."""
    places, signs = index_vectors()
    total = np.zeros((1 << BITS) * DIMS, np.int64)
    seen = np.zeros(1 << BITS, np.int64)
    salt = 0
    for batch in T.slices(batches, SLICE):
        tok, first = token_buckets(batch.column("text"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        seen += np.bincount(tok, minlength=1 << BITS)
        salt += len(tok)
        for d in range(1, WINDOW + 1):
            same = row[d:] == row[:-d]
            left, right = tok[:-d][same], tok[d:][same]
            for at, near in ((left, right), (right, left)):
                for e in range(ENTRIES):
                    flat, plus = at * DIMS + places[near, e], signs[near, e] > 0
                    total += np.bincount(flat[plus], minlength=len(total))
                    total -= np.bincount(flat[~plus], minlength=len(total))
    both = np.concatenate([total.reshape(BLOCKS, -1), seen.reshape(BLOCKS, -1)], 1)
    yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([salt % SALTS] * BLOCKS, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in both], pa.binary())], names=["block", "salt", "sums"])


def _add(batches):
    """Sums by block, one row in memory at a time."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist()):
            x = np.frombuffer(zlib.decompress(blob), np.int64)
            total[block] = total[block] + x if block in total else x.copy()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([0] * len(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["block", "salt", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """float32 [buckets, DIMS], from all documents. Sums meet in two rounds, so no task gets a row from every task."""
    kind = "block int, salt int, sums binary"
    sums = in_small_batches(docs).select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_contexts, kind)
    sums = sums.repartition(BLOCKS * SALTS, "block", "salt").mapInArrow(_add, kind)
    sums = sums.repartition(BLOCKS, "block").mapInArrow(_add, kind).collect()  # BLOCKS rows
    total, seen = np.zeros((1 << BITS, DIMS), np.float64), np.zeros(1 << BITS)
    n = (1 << BITS) // BLOCKS
    for r in sums:
        x = np.frombuffer(zlib.decompress(bytes(r.sums)), np.int64)
        total[r.block * n : (r.block + 1) * n], seen[r.block * n : (r.block + 1) * n] = x[: n * DIMS].reshape(n, DIMS), x[n * DIMS :]
    rate = total / np.maximum(seen, 1)[:, None]
    rate -= total.sum(0) / max(seen.sum(), 1)
    size = np.linalg.norm(rate, axis=1)
    return np.where((size > 0)[:, None] & (seen > 0)[:, None], rate / np.maximum(size, 1e-12)[:, None], 0).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean word vector of each row."""
    tok, first = token_buckets(column)
    n = np.diff(first)
    out = np.zeros((len(n), DIMS), np.float64)
    some = np.flatnonzero(n)
    if len(some):
        out[some] = np.add.reduceat(vectors[tok], first[some], axis=0, dtype=np.float64) / n[some][:, None]
    return out


@dataclass
class Net:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit_net(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Net | None:
    """Adam on folds 1 to 3, the temperature on fold 0."""
    tx, ty = x[fold > 0], y[fold > 0]
    if not len(ty) or ty.min() == ty.max():
        return None
    rng = np.random.default_rng(SEED)
    net = Net(tx.mean(0), tx.std(0) + 1e-6, rng.normal(0, DIMS**-0.5, (DIMS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = (tx - net.mean) / net.scale
    theta = [net.w1, net.b1, net.w2, np.array(net.b2)]
    m, v = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, STEPS + 1):
        h = np.tanh(z @ theta[0] + theta[1])
        d = (1 / (1 + np.exp(-np.clip(h @ theta[2] + theta[3], -500, 500))) - ty) / len(ty)
        back = np.outer(d, theta[2]) * (1 - h * h)
        grads = [z.T @ back + 1e-4 * theta[0], back.sum(0), h.T @ d + 1e-4 * theta[2], d.sum()]
        for k, g in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            theta[k] = theta[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = theta[0], theta[1], theta[2], float(theta[3])
    vx, vy = x[fold == 0], y[fold == 0]
    if len(vy):
        raw = net.logits(vx)
        loss = lambda t: np.logaddexp(0, np.where(vy == 1, -raw, raw) / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 64, 300), key=loss))
    return net


def score_quality(docs: DataFrame, vectors: np.ndarray, net: Net | None, *, text_col: str = "text", carry=("doc_id",)) -> DataFrame:
    """docs[carry] with score."""
    docs = in_small_batches(docs).select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if net is None:
        return docs.select(*carry, F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast((vectors, net))

    def run(batches):
        vectors, net = shared.value
        for batch in T.slices(batches, SLICE, "_text"):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(net.scores(pooled(batch.column("_text"), vectors)))], names=[*carry, "score"])

    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry), "score double"]))


def quality_model(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, Net | None]:
    """Word vectors of all documents; the network of labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    sample = training_sample(docs, labels, "quality", ~held_out(F.col("doc_id"), 3, 1), limit)
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for batch in T.slices(batches, SLICE):
            x = pooled(batch.column("text"), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("y"), batch.column("fold")], names=["x", "y", "fold"])

    got = sample.mapInArrow(run, "x array<double>, y int, fold int").toArrow()  # limit rows at most
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, DIMS)
    y, fold = got["y"].to_numpy(), got["fold"].to_numpy()
    order = np.lexsort((*x.T, fold, y))  # the same fit in whatever order the rows come
    return vectors, fit_net(x[order], y[order], fold[order])


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_quality(docs, *quality_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_quality": op1_quality}
SQL: dict[str, str] = {}
