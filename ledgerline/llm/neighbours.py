"""Operator 10: approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. Nodes are dealt to shards by a hash of their id; a shard is one task and has a graph of its own,
so nothing of a round leaves a task. Nodes start with the best of a few hundred others on the same side of random hyperplanes,
and of a few hundred that a plain shuffle deals to them, so that none starts alone; then each round joins every node to its
neighbours and some reverse neighbours and compares those with one another (pairs with at least one new member), until few
edges change. Shards, and with them the edges of a node and the beam of a query (``sizes``), grow with the number of nodes
up to a bound. Vectors travel as 16-bit codes.

Every query walks the graph of every shard, from its own node, where that is in the shard, and from the best of one in four
nodes of the shard, so that it meets groups that no edge leads to. It keeps the best nodes seen, as many as the beam holds, and looks at all neighbours and reverse
neighbours of those not yet looked at, until none is left. The best of all shards are ranked again by the cosine of the
original vectors in double precision; nodes are expanded to the smallest ids of their equal vectors, so ties go to the smaller id.

Nothing is dropped to escape skew: shards are dealt by a hash, reverse lists and edges are short by definition of the graph, and
a node of many equal vectors needs only its first ids to answer any query.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no
part; vectors are compared with those of their own length (each length is a graph of its own); with
fewer candidates than asked for, all are returned; components of any finite size are scaled by powers
of two, so squares neither overflow nor vanish; an empty table gives no rows; other columns of the
input are ignored. The id column must be of an integer type.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm import tokens as T
from ledgerline.llm.common import integer_id, stored, table

SMALL = 10_000  # up to so many nodes EDGES and BEAM hold; they grow from there
EDGES, BEAM = 24, 96
SHARD, LARGEST, SHARDS = 8192, 65_536, 24  # nodes of a shard: so many at least and at most; in between there are SHARDS shards
CELL, TABLES = 256, 2  # nodes of a cell of the first step, and how often nodes are dealt
ENTRIES, EVERY = 256, 4  # nodes of a shard that every query is compared with: so many at least, and one in so many; a group without edges to others has more nodes than edges a node
STEP, BLOCK = 8, 128  # nodes of a pool that a step looks at, and queries that walk together
TELL = 10  # edges that one node's round offers to each neighbour
FEW = 0.02  # share of new edges that ends the rounds
SEED = 5
AGAIN = 32  # best nodes that are ranked again


def sizes(n: int) -> tuple[int, int]:
    """Edges of a node and beam of a query for n nodes: they grow as the fourth and the square root."""
    more = max(1.0, n / SMALL)
    return int(np.ceil(EDGES * more**0.25)), int(np.ceil(BEAM * more**0.5))


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vec.isNotNull() & finite & F.exists(vec, lambda x: x != 0)


def _codes(batches):
    for batch in batches:
        rows = [np.asarray(v, np.float64) for v in batch.column("vec").to_pylist()]
        out = [np.round(v / np.abs(v).max() * 32767).astype("<i2").tobytes() for v in rows]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "code"])


def _unit(blobs: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), "<i2").reshape(len(blobs), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _column(held, name):
    return sum((b.column(name).to_pylist() for b in held), [])


def _numbers(held, name) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in held])


def _shard(n: int) -> tuple[int, Column]:
    """How many shards n nodes have, and the shard of ``node``."""
    shards = max(1, -(-n // min(LARGEST, max(SHARD, n // SHARDS))))
    return shards, F.pmod(F.xxhash64(F.lit(SEED), "node"), F.lit(shards)).cast("int")


def _dealt(df: DataFrame, shards: int, *then: str) -> DataFrame:
    return df.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", *then)


def _leaves(x: np.ndarray, cell: int, rng):
    """The nodes, halved by random hyperplanes until no part has more than ``cell``."""
    parts = [np.arange(len(x))]
    while parts:
        part = parts.pop()
        if len(part) <= cell:
            yield part
            continue
        half = len(part) // 2
        order = np.argpartition(x[part] @ rng.normal(size=x.shape[1]).astype(np.float32), half)
        parts += [part[order[:half]], part[order[half:]]]


def _best_edges(u, v, s, fresh, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` best edges of each of n nodes: neighbours (-1: none), likeness, freshness. Of equal edges the first counts."""
    _, at = np.unique(u * n + v, return_index=True)
    u, v, s, fresh = u[at], v[at], s[at], fresh[at]
    order = np.argsort(u * 4 - s.astype(np.float64), kind="stable")
    u, v, s, fresh = u[order], v[order], s[order], fresh[order]
    place = np.arange(len(u)) - np.searchsorted(u, u)
    kept = place < most
    near, sim, new = np.full((n, most), -1), np.full((n, most), -9, np.float32), np.zeros((n, most), bool)
    at = u[kept], place[kept]
    near[at], sim[at], new[at] = v[kept], s[kept], fresh[kept]
    return near, sim, new


def _reverse(near: np.ndarray, most: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` of the nodes that have each node as a neighbour (-1: none), and their places in the flattened edges."""
    at = rng.permutation(np.flatnonzero(near.ravel() >= 0))
    v = near.ravel()[at]
    order = np.argsort(v, kind="stable")
    at, v = at[order], v[order]
    place = np.arange(len(v)) - np.searchsorted(v, v)
    kept = place < most
    back, edge = np.full((len(near), most), -1), np.zeros((len(near), most), np.int64)
    back[v[kept], place[kept]], edge[v[kept], place[kept]] = at[kept] // near.shape[1], at[kept]
    return back, edge


def descend(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The neighbour graph of unit vectors: neighbours (-1: none) and likeness of each node, best first."""
    n, rng = len(x), np.random.default_rng(SEED)
    most = sizes(n)[0]
    cells = [leaf for _ in range(TABLES) for leaf in _leaves(x, CELL, rng)]
    cells += np.array_split(rng.permutation(n), max(1, n // max(CELL, 4 * most)))
    found = []
    for cell in cells:
        k = min(most, len(cell) - 1)
        if k > 0:
            s = x[cell] @ x[cell].T
            np.fill_diagonal(s, -9)
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            found.append((np.repeat(cell, k), cell[best].ravel(), np.take_along_axis(s, best, 1).ravel()))
    if not found:
        return np.full((n, most), -1), np.full((n, most), -9, np.float32)
    u, v, s = (np.concatenate(c) for c in zip(*found))
    near, sim, fresh = _best_edges(u, v, s, np.ones(len(u), bool), n, most)
    while fresh.sum() > FEW * (near >= 0).sum():
        back, edge = _reverse(near, most // 2, rng)
        both = np.hstack([near, back])
        new = np.hstack([fresh, fresh.ravel()[edge] & (back >= 0)])
        worst = np.append(sim.min(1), 9)  # none is better than what node -1 has
        has = near >= 0
        found = [(np.repeat(np.arange(n), has.sum(1)), near[has], sim[has])]
        for a in range(0, n, 512):
            b = both[a : a + 512]
            s = x[b] @ x[b].transpose(0, 2, 1)
            good = (new[a : a + 512, :, None] | new[a : a + 512, None, :]) & (b[:, None, :] >= 0) & (b[:, :, None] != b[:, None, :]) & (s > worst[b][:, :, None])
            s = np.where(good, s, -9).reshape(-1, b.shape[1])
            k = min(TELL, b.shape[1])
            best = np.argpartition(-s, k - 1, axis=1)[:, :k]
            value = np.take_along_axis(s, best, 1)
            i, j = np.nonzero(value > -9)
            found.append((b.ravel()[i], b[i // b.shape[1], best[i, j]], value[i, j]))
        u, v, s = (np.concatenate(c) for c in zip(*found))
        near, sim, fresh = _best_edges(u, v, s, np.arange(len(u)) >= len(found[0][0]), n, most)
    return near, sim


def _graph_of(batches):
    for _, held in T.groups(batches, 1):
        node = _numbers(held, "node")
        near, sim = descend(_unit(_column(held, "code")))
        for a in range(0, len(node), 2048):
            i, j = np.nonzero(near[a : a + 2048] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(node[a + i]), pa.array(node[near[a + i, j]]), pa.array(sim[a + i, j].astype(np.float64))], names=["u", "v", "sim"])


def graph(codes: DataFrame) -> DataFrame:
    """Edges (u, v, sim) of the neighbour graph over codes (node, code): both ends are in one shard."""
    shards, shard = _shard(codes.count())
    return _dealt(codes.select(shard.alias("shard"), "node", "code"), shards, "node").mapInArrow(_graph_of, "u long, v long, sim double")


def walk(x: np.ndarray, near: np.ndarray, asks: np.ndarray, own: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Pools of queries ``asks`` after greedy search over the graph ``near``, best first: nodes (-1: none), likeness. ``own``: a query's node, or -1."""
    n, m = len(x), len(asks)
    starts = np.linspace(0, n - 1, min(n, max(ENTRIES, n // EVERY))).astype(np.int64)
    s = asks @ x[starts].T
    k = min(beam, STEP, len(starts))
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    pool, sim = np.hstack([own[:, None], starts[best]]), np.hstack([np.where(own >= 0, 2, -9)[:, None], np.take_along_axis(s, best, 1)]).astype(np.float32)
    sim[:, 1:][pool[:, 1:] == own[:, None]] = -9
    pool[sim == -9] = -1
    seen = pool < 0
    stamp = np.full((m, n), -1, np.int32)
    i, j = np.nonzero(pool >= 0)
    stamp[i, pool[i, j]] = 0
    while True:
        turn = ~seen & (np.cumsum(~seen, axis=1) <= STEP)
        i, j = np.nonzero(turn)
        if not len(i):
            return pool, sim
        seen |= turn
        found, row = near[pool[i, j]].ravel(), np.repeat(i, near.shape[1])
        new = found >= 0
        found, row = found[new], row[new]
        new = stamp[row, found] < 0
        found, row = found[new], row[new]
        stamp[row, found] = np.arange(len(row))
        new = stamp[row, found] == np.arange(len(row))  # each once
        found, row = found[new], row[new]
        count = np.bincount(row, minlength=m)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        more, value = np.full((m, count.max()), -1), np.full((m, count.max()), -9, np.float32)
        more[row, place], value[row, place] = found, np.einsum("ij,ij->i", x[found], asks[row])
        pool, sim, seen = np.hstack([pool, more]), np.hstack([sim, value]), np.hstack([seen, more < 0])
        order = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
        pool, sim, seen = (np.take_along_axis(c, order, 1) for c in (pool, sim, seen))


def _walks(best: int | None):
    return lambda batches: _walks_of(batches, best)


def _walks_of(batches, best: int | None):
    """Rows (shard, kind, a, b, code), sorted by shard and kind: nodes (0), edges (1), queries (2) -> the pools of the queries."""
    for _, held in T.groups(batches, 1):
        kind, a, b = _numbers(held, "kind"), _numbers(held, "a"), _numbers(held, "b")
        code = pa.chunked_array([c.column("code") for c in held])
        picked = lambda k: _unit(code.filter(pa.array(kind == k)).to_pylist())
        if not (kind == 0).any() or not (kind == 2).any():
            continue
        order = np.argsort(a[kind == 0], kind="stable")
        node, x = a[kind == 0][order], picked(0)[order]
        most, beam = sizes(len(node))
        u, v = np.searchsorted(node, a[kind == 1]), np.searchsorted(node, b[kind == 1])
        near = _best_edges(u, v, np.zeros(len(u)), np.zeros(len(u), bool), len(node), max(1, np.bincount(u, minlength=1).max()))[0]
        near = np.hstack([near, _reverse(near, most, np.random.default_rng(SEED))[0]])
        q, y = a[kind == 2], picked(2)
        own = np.minimum(np.searchsorted(node, q), len(node) - 1)
        own = np.where(node[own] == q, own, -1)
        for k in range(0, len(q), BLOCK):
            pool, sim = walk(x, near, y[k : k + BLOCK], own[k : k + BLOCK], beam)
            i, j = np.nonzero(pool[:, :best] >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(q[k + i]), pa.array(node[pool[i, j]]), pa.array(sim[i, j].astype(np.float64))], names=["q", "v", "sim"])


def search(edges: DataFrame, codes: DataFrame, queries: DataFrame, best: int | None = None) -> DataFrame:
    """Pools (q, v, sim) of nodes ``queries.q`` after greedy search, or the ``best`` of each shard's pool; a query's own node counts 2."""
    shards, shard = _shard(codes.count())
    none, no_code = F.lit(0).cast("long").alias("b"), F.lit(None).cast("binary").alias("code")
    rows = codes.select(shard.alias("shard"), F.lit(0).alias("kind"), F.col("node").alias("a"), none, "code")
    rows = rows.unionByName(edges.withColumn("node", F.col("u")).select(shard.alias("shard"), F.lit(1).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), no_code))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    rows = rows.unionByName(queries.join(codes.toDF("q", "code"), "q").select(every, F.lit(2).alias("kind"), F.col("q").alias("a"), none, "code"))
    return _dealt(rows, shards, "kind", "a").mapInArrow(_walks(best), "q long, v long, sim double")


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two (exact), so that the largest component is about 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _cosine(batches):
    """Rows (q, v, x, y), vectors of one length: cosine in double precision."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (_scaled(batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)) for c in ("x", "y"))
        dot = lambda x, y: np.matmul(x[:, None, :], y[:, :, None]).ravel()
        yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("v"), pa.array(dot(a, b) / (np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))))], names=["q", "v", "score"])


def _of_one_length(rows: DataFrame, k: int) -> DataFrame:
    nodes = stored(rows.groupBy("vec").agg(F.min("vec_id").alias("node")))
    ids = stored(rows.join(nodes, "vec").select("vec_id", "node", "asks"))
    codes = stored(nodes.mapInArrow(_codes, "node long, code binary"))
    pool = search(stored(graph(codes)), codes, ids.where("asks").select(F.col("node").alias("q")).distinct(), max(AGAIN, k + 1))
    again = Window.partitionBy("q").orderBy(F.desc("sim"), "v")
    pool = pool.withColumn("_n", F.row_number().over(again)).where(F.col("_n") <= max(AGAIN, k + 1)).drop("_n")
    pool = pool.join(nodes.toDF("x", "q"), "q").join(nodes.toDF("y", "v"), "v").select("q", "v", "x", "y")
    scored = stored(pool.mapInArrow(_cosine, "q long, v long, score double"))
    # a node's first k + 1 ids answer any query
    w = Window.partitionBy("node").orderBy("vec_id")
    firsts = ids.select("vec_id", "node").distinct().withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1).select(F.col("node").alias("v"), "vec_id")
    asks = ids.where("asks").select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).distinct()
    best = scored.join(firsts, "v").withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1)
    got = asks.join(best.select("q", "vec_id", "score"), "q").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``is_query`` (of the id column) marks."""
    rows = vectors.select(integer_id(vectors, id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks"))
    rows = rows.where(usable(F.col("vec")) & F.col("vec_id").isNotNull())
    lengths = sorted(r.n for r in rows.select(F.size("vec").alias("n")).distinct().collect())
    return reduce(DataFrame.unionByName, [_of_one_length(rows.where(F.size("vec") == n), k) for n in lengths or [0]])


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op10_neighbours": op10_neighbours}
SQL: dict[str, str] = {}
