"""Operator 8: token counts by a linear longest-match automaton.

A word's greedy word pieces are the longest vocabulary entry that its bytes start with, then the
longest of what is left, and so on. The automaton is the vocabulary's trie with, for each node,
a failure link (the node reached after popping the pieces that are then certain) and the number
of pieces popped. A scan follows trie edges, adds the popped counts where it fails, and never
builds a piece or looks back; ``ends`` has the pieces of a word that ends at a node.

Each word is matched with ``lead`` before it (for byte-level vocabularies, a space). A word that
cannot be covered counts as one unknown piece. Distinct words of a slice are matched once, all of
them side by side in numpy; words of more than ``LONG`` bytes one by one.

Defined results: null, empty and blank texts have no words and no tokens; equal texts have equal
counts; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import tokens as T
from ledgerline.llm.common import in_small_batches, table
from ledgerline.llm.packing import _byte_names, vocabulary_path

SLICE = 2 << 20
LONG = 256
LEAD = b" "


def byte_vocabulary(path: str) -> list[bytes]:
    """Entries of a byte-level BPE file, as bytes."""
    back = {name: b for b, name in enumerate(_byte_names())}
    with open(path, encoding="utf-8") as file:
        entries = json.load(file)["model"]["vocab"]
    return [bytes(back[c] for c in entry) for entry in entries if all(c in back for c in entry)]


class Automaton:
    """Trie nodes are numbered in breadth-first order, the root 0; -1: no node."""

    def __init__(self, vocabulary: list[bytes]):
        edges: dict[int, int] = {}
        made: list[tuple[int, int]] = [(-1, 0)]  # parent, byte
        final = [False]
        frontier = [(0, sorted({v for v in vocabulary if v}), 0)]
        while frontier:
            following = []
            for node, entries, depth in frontier:
                groups: dict[int, list[bytes]] = {}
                for v in entries:
                    groups.setdefault(v[depth], []).append(v)
                for byte, own in groups.items():
                    child = len(made)
                    edges[node << 8 | byte] = child
                    made.append((node, byte))
                    final.append(any(len(v) == depth + 1 for v in own))
                    if rest := [v for v in own if len(v) > depth + 1]:
                        following.append((child, rest, depth + 1))
            frontier = following
        n = len(made)
        link, popped = [-1] * n, [0] * n
        for v in range(1, n):
            parent, byte = made[v]
            if final[v]:
                link[v], popped[v] = 0, 1
                continue
            z, count = link[parent], popped[parent]
            while z >= 0 and (z << 8 | byte) not in edges:
                count += popped[z]
                z = link[z]
            if z >= 0:
                link[v], popped[v] = edges[z << 8 | byte], count
        ends = [0] * n
        for v in range(1, n):  # links go to shorter strings, so to smaller numbers
            ends[v] = -1 if link[v] < 0 or ends[link[v]] < 0 else popped[v] + ends[link[v]]
        self.edges = edges
        self.link, self.popped, self.ends = (np.array(x, np.int32) for x in (link, popped, ends))
        keys = np.fromiter(edges, np.int64, len(edges))
        self.mask = (1 << max(4, (4 * len(keys)).bit_length())) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        left, slot = keys, self._slot(keys)
        while len(left):  # linear probing, all keys at once
            free = self.keys[slot] < 0
            take = np.flatnonzero(free)[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[take]] = left[take]
            stay = self.keys[slot] != left
            left, slot = left[stay], (slot[stay] + 1) & self.mask
        found = np.flatnonzero(self.keys >= 0)
        self.values[found] = [edges[k] for k in self.keys[found].tolist()]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (T.mix64(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children, or -1."""
        key = state.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        out = self.values[slot]
        wrong = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0))
        out[self.keys[slot] < 0] = -1
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            at = self.keys[slot[wrong]]
            hit = at == key[wrong]
            out[wrong] = np.where(hit, self.values[slot[wrong]], -1)
            wrong = wrong[~hit & (at >= 0)]
        return out

    def one(self, word: bytes, lead: bytes = b"") -> int:
        """Pieces of a word."""
        edges, link, popped = self.edges, self.link, self.popped
        state, count = 0, 0
        for byte in lead + word:
            while (child := edges.get(state << 8 | byte)) is None:
                if link[state] < 0:
                    return 1
                count += int(popped[state])
                state = int(link[state])
            state = child
        return 1 if self.ends[state] < 0 else count + int(self.ends[state])

    def many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: bytes = b"") -> np.ndarray:
        """Pieces of data[start:end], with ``lead`` before each."""
        n = len(starts)
        out = np.zeros(n, np.int64)
        long = np.flatnonzero(ends - starts > LONG)
        for i in long.tolist():
            out[i] = self.one(data[starts[i] : ends[i]].tobytes(), lead)
        begin = 0
        for byte in lead:
            child = self.edges.get(begin << 8 | byte)
            if child is None:
                return np.array([self.one(data[a:z].tobytes(), lead) for a, z in zip(starts, ends)], np.int64)
            begin = child
        who = np.flatnonzero(ends - starts <= LONG)
        at, state, count = starts[who].copy(), np.full(len(who), begin, np.int32), np.zeros(len(who), np.int64)
        while len(who):
            done = at == ends[who]
            if done.any():
                last = self.ends[state[done]]
                out[who[done]] = np.where(last < 0, 1, count[done] + last)
                who, at, state, count = who[~done], at[~done], state[~done], count[~done]
                if not len(who):
                    break
            child = self.step(state, data[at])
            went = child >= 0
            link = self.link[state]
            stuck = ~went & (link < 0)
            count += np.where(went, 0, self.popped[state])
            at += went
            state = np.where(went, child, link)
            if stuck.any():
                out[who[stuck]] = 1
                who, at, state, count = who[~stuck], at[~stuck], state[~stuck], count[~stuck]
        return out


@functools.cache
def automaton(path: str) -> Automaton:
    return Automaton(byte_vocabulary(path))


def token_counts(docs: DataFrame, *, text_col: str = "text", vocabulary: str | None = None, lead: bytes = LEAD, carry=("doc_id",)) -> DataFrame:
    """docs[carry] with n_words, n_tokens and longest: the most pieces of one word."""
    path = vocabulary or vocabulary_path()
    docs = in_small_batches(docs).select(*carry, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def run(batches):
        for batch in T.slices(batches, SLICE, "_text"):
            data, offsets = T.text_bytes(batch.column("_text"))
            starts, ends, row = T.words(data, offsets)
            n = len(offsets) - 1
            words, tokens, longest = np.bincount(row, minlength=n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            if len(starts):
                _, first, which = np.unique(T.hashes(data, starts, ends), return_index=True, return_inverse=True)
                pieces = automaton(path).many(data, starts[first], ends[first], lead)[which]
                tokens = np.bincount(row, pieces, minlength=n).astype(np.int64)
                np.maximum.at(longest, row, pieces)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(words.astype(np.int64)), pa.array(tokens), pa.array(longest)], names=[*carry, "n_words", "n_tokens", "longest"])

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]
    return docs.mapInArrow(run, ", ".join([*kinds, "n_words long, n_tokens long, longest long"]))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_counts": op8_token_counts}
SQL: dict[str, str] = {}
