"""Sorted Arrow batches, cut where their leading columns change."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of equal leading ``keys`` columns in sorted batches, as lists of batches."""
    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, z in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(a, z - a))
    if held:
        yield last, held
