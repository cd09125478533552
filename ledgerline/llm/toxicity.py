"""Operator 4: toxicity by maximum-scoring segments.

Tokens are runs of letters and digits, lower-cased. A token's log-odds of standing in a toxic
text come from counts with hierarchical Dirichlet priors: the prior of a word is the estimate
for its first six bytes, whose prior is that of the first five, then four, then the share of
toxic tokens; ``strength`` pseudo-counts each. A token counts once a document, in hashed tables
of fixed size; words in two, of which the lower estimate holds.

Log-odds, less some of their standard deviations and a drift, are scores whose expectation over clean text is negative. One linear scan
(Ruzzo and Tompa) finds all maximal scoring segments of a document. Their significance follows
extreme-value theory: the largest segment of n clean tokens exceeds S with probability
1 - exp(-K n exp(-lambda S)); lambda solves E[exp(lambda s)] = 1 over clean tokens and K is
fitted to the largest segments of clean documents, both on a fold that the counts left out.
A document's score is a logistic function, fitted on that fold, of the surprise of its best
segment and of the number of significant segments.

Defined results: null and empty texts have no segment and get the base score; equal texts have
equal scores; with no labelled rows of both kinds every score is 0; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import tokens as T
from ledgerline.llm.common import in_small_batches, table
from ledgerline.llm.labelled import MAX_LABELLED, held_out, training_sample

U = np.uint64
PREFIXES = (6, 5, 4)
BITS = (19, 19, 18, 18, 18)  # of the two tables of words and of the prefixes
STRENGTH = 10.0
DEVIATIONS, DRIFT, LEAST, MOST = 1.5, 0.3, -1.0, 6.0
LOG_SIGNIFICANT = math.log(0.01)  # of E-values
SLICE = 2 << 20
_AT = np.cumsum([0, *(1 << b for b in BITS)])
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte letters U+00C0 to U+00DE."""
    out = T.lower_ascii(data)
    if len(out) > 1:
        wide = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
        out[1:][wide] += np.uint8(0x20)
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token the five table places; starts, ends as bytes; first token of each row (one more)."""
    data, offsets = T.text_bytes(column)
    data = _lower(data)
    starts, ends = T.runs(_LETTER[data], offsets)
    first = np.searchsorted(starts, offsets)
    places = np.empty((5, len(starts)), np.int64)
    word = T.hashes(data, starts, ends)
    places[0] = (word & U((1 << BITS[0]) - 1)).astype(np.int64)
    places[1] = (word >> U(64 - BITS[1])).astype(np.int64) + _AT[1]
    h, size = np.zeros(len(starts), U), ends - starts
    for j in range(max(PREFIXES)):
        inside = size > j
        h += np.where(inside, T._BYTE[data[np.where(inside, starts + j, 0)]] * T._powers(16)[j], U(0)) if len(starts) else U(0)
        if j + 1 in PREFIXES:
            k = PREFIXES.index(j + 1) + 2
            places[k] = (T.mix64(h) & U((1 << BITS[k]) - 1)).astype(np.int64) + _AT[k]
    return places, first, np.stack([starts, ends])


@dataclass
class Model:
    counts: np.ndarray  # float32 [2, all tables]: clean, toxic
    base: float  # share of toxic tokens
    strength: float = STRENGTH
    lam: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def scores(self, places: np.ndarray) -> np.ndarray:
        def estimate(k, prior):
            clean, toxic = self.counts[0][places[k]], self.counts[1][places[k]]
            return clean + self.strength * (1 - prior), toxic + self.strength * prior

        q = np.full(places.shape[1], self.base, np.float32)
        for k in (4, 3, 2):
            clean, toxic = estimate(k, q)
            q = toxic / (toxic + clean)
        least = None
        for k in (0, 1):  # a word that shares a place in one table seldom does in the other
            clean, toxic = estimate(k, q)
            odds = np.log(toxic / clean) - np.float32(math.log(self.base) - math.log1p(-self.base)) - DEVIATIONS * np.sqrt(1 / toxic + 1 / clean)
            least = odds if least is None else np.minimum(least, odds)
        return np.clip(least - DRIFT, LEAST, MOST)

    def log_e(self, s: float, n: int) -> float:
        """Log of the expected number of clean segments of that score in n tokens."""
        return self.log_k + math.log(max(n, 1)) - self.lam * s


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score), by one scan over the positive scores."""
    total = np.cumsum(score, dtype=np.float64)
    at = np.flatnonzero(score > 0)
    open_: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    for i, after in zip(at.tolist(), total[at].tolist()):
        before, first = after - float(score[i]), i
        while True:
            j = len(open_) - 1
            while j >= 0 and open_[j][0] >= before:
                j -= 1
            if j < 0 or open_[j][1] >= after:
                open_.append((before, after, first, i + 1))
                break
            before, first = open_[j][0], open_[j][2]
            del open_[j:]
    return [(a, z, r - l) for l, r, a, z in open_]


def _summary(model: Model, score: np.ndarray) -> tuple[float, int, list]:
    """Surprise of the best segment, number of significant ones, the significant ones."""
    found = segments(score)
    if not found:
        return 0.0, 0, []
    n = len(score)
    good = [(a, z, s, math.exp(e)) for a, z, s in found if (e := model.log_e(s, n)) <= LOG_SIGNIFICANT]
    return max(0.0, -model.log_e(max(s for _, _, s in found), n)), len(good), good


def _shown(model: Model, surprise, n):
    w = model.weights
    return 1 / (1 + np.exp(-(w[0] + w[1] * np.minimum(surprise, 60.0) + w[2] * np.log1p(n))))


def fit(sample: DataFrame, strength: float = STRENGTH) -> Model | None:
    """Counts on folds 1 to 3, extreme values and the logistic on fold 0. The tables have a fixed size."""

    def count(batches):
        kept = np.zeros((2, _AT[-1]), np.int64)
        for batch in T.slices(batches, SLICE):
            places, first, _ = features(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))
            y = batch.column("y").to_numpy()[row]
            for label in (0, 1):
                for k in range(5):
                    once = np.unique(np.stack([row[y == label], places[k][y == label]]), axis=1)[1] if (y == label).any() else []
                    kept[label] += np.bincount(once, minlength=_AT[-1])
        for label in (0, 1):
            at = np.flatnonzero(kept[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label)), pa.array(at), pa.array(kept[label][at])], names=["y", "at", "n"])

    found = in_small_batches(sample).where("fold > 0").mapInArrow(count, "y long, at long, n long").groupBy("y", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, _AT[-1]), np.float32)
    counts[found["y"].to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
    clean, toxic = (float(counts[k][: 1 << BITS[0]].sum()) for k in (0, 1))
    if not clean or not toxic:
        return None
    model = Model(counts, toxic / (clean + toxic), strength)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def clean_scores(batches):
        edges = np.linspace(LEAST, MOST, 141)
        for batch in T.slices(batches, SLICE):
            places, first, _ = features(batch.column("text"))
            score = shared.value.scores(places)
            rows = [(int(y), max([s for _, _, s in segments(score[a:z])], default=0.0), int(z - a), np.histogram(score[a:z], edges)[0].tolist()) for y, a, z in zip(batch.column("y").to_pylist(), first, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["y", "best", "n", "bins"])

    rows = sample.where("fold = 0").mapInArrow(clean_scores, "y long, best double, n long, bins array<long>").collect()  # a quarter of the bounded sample
    clean_rows = [r for r in rows if r.y == 0 and r.n]
    if not clean_rows or not any(r.y for r in rows):
        rows = clean_rows = []
    mid = np.linspace(LEAST, MOST, 141)[:-1] + (MOST - LEAST) / 280
    p = np.sum([r.bins for r in clean_rows], axis=0) if clean_rows else np.ones(140)
    p = p / p.sum()
    low, high = 1e-3, 20.0
    for _ in range(80):
        lam = (low + high) / 2
        low, high = (lam, high) if (p * np.exp(lam * mid)).sum() < 1 else (low, lam)
    model.lam = (low + high) / 2
    best = [r for r in clean_rows if r.best > 0]
    model.log_k = float(np.mean([model.lam * r.best - math.log(r.n) for r in best]) - np.euler_gamma) if best else 0.0
    model.log_k = max(-10.0, min(5.0, model.log_k))
    if not rows:
        model.weights = (-3.0, 0.5, 0.5)
        return model
    shared.unpersist()
    shared2 = sample.sparkSession.sparkContext.broadcast(model)

    def summaries(batches):
        for batch in T.slices(batches, SLICE):
            places, first, _ = features(batch.column("text"))
            score = shared2.value.scores(places)
            rows = [(int(y), *_summary(shared2.value, score[a:z])[:2]) for y, a, z in zip(batch.column("y").to_pylist(), first, first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["y", "surprise", "n"])

    got = sample.where("fold = 0").mapInArrow(summaries, "y long, surprise double, n long").toArrow()
    x = np.stack([np.ones(got.num_rows), np.minimum(got["surprise"].to_numpy(), 60.0), np.log1p(got["n"].to_numpy())], 1)
    y = got["y"].to_numpy().astype(float)
    w = np.array([-3.0, 0.5, 0.5])
    ridge = np.diag([1e-3, 1e-2, 1e-2])
    for _ in range(60):  # Newton, with a ridge so that separable data converge
        q = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (q * (1 - q) + 1e-9)) @ x + ridge, x.T @ (y - q) - ridge @ w)
        w += np.clip(step, -2, 2)
    model.weights = tuple(float(v) for v in w)
    return model


def score_toxicity(docs: DataFrame, model: Model | None, *, text_col: str = "text", carry=("doc_id",)) -> DataFrame:
    """docs[carry] with score, n_passages and passages: array<struct<start, end, score, e_value>> in bytes of UTF-8."""
    spark = docs.sparkSession
    text = text_col if text_col in carry else "_text"
    docs = in_small_batches(docs).select(*carry, *([] if text_col in carry else [F.col(text_col).alias("_text")]))
    kind = "score double, n_passages int, passages array<struct<start:int,end:int,score:double,e_value:double>>"
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    if model is None:
        return docs.select(*carry, F.lit(0.0).alias("score"), F.lit(0).alias("n_passages"), F.expr("cast(array() as array<struct<start:int,end:int,score:double,e_value:double>>)").alias("passages"))
    shared = spark.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def run(batches):
        model = shared.value
        for batch in T.slices(batches, SLICE, text):
            column = batch.column(text)
            places, first, span = features(column)
            base = T.text_bytes(column)[1]
            score = model.scores(places)
            surprise, n, found = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32), []
            hit = np.add.reduceat(np.append(score > 0, False).astype(np.int64), np.minimum(first[:-1], len(score))) * (np.diff(first) > 0) if batch.num_rows else []
            for i in range(batch.num_rows):
                good = []
                if hit[i]:
                    a, z = first[i], first[i + 1]
                    surprise[i], n[i], good = _summary(model, score[a:z])
                    good = [{"start": int(span[0][a + s] - base[i]), "end": int(span[1][a + e - 1] - base[i]), "score": float(v), "e_value": float(ev)} for s, e, v, ev in good]
                found.append(good)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(_shown(model, surprise, n)), pa.array(n, pa.int32()), pa.array(found, passage)], names=[*carry, "score", "n_passages", "passages"])

    return docs.mapInArrow(run, ", ".join([*fields, kind]))


def toxicity_model(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model | None:
    """Fitted on labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    return fit(training_sample(docs, labels, "toxic", ~held_out(F.col("doc_id"), 5, 0), limit))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
