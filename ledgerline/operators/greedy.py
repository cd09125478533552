"""Order-dependent choices: each is a scan over one sorted group (applyInPandas), never over the whole table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ledgerline.operators.series import first_fit, monotonic_guard


def overlap_dedupe(df: DataFrame, group: str, key: str, points: str, share: float) -> DataFrame:
    """Longest first; a member is dropped when it shares ``share`` of its points with one kept before. Ties by key."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_n=pdf[points].map(len)).sort_values(["_n", key], ascending=[False, True])
        kept: list[set] = []
        owner: dict[int, list[int]] = {}  # point -> kept sets that hold it
        flags = []
        for p in pdf[points]:
            own = set(p)
            hits: dict[int, int] = {}
            for x in own:
                for k in owner.get(x, ()):
                    hits[k] = hits.get(k, 0) + 1
            good = not hits or max(hits.values()) < share * len(own)
            flags.append(good)
            if good:
                for x in own:
                    owner.setdefault(x, []).append(len(kept))
                kept.append(own)
        return pd.DataFrame({key: pdf[key].to_numpy(), "kept": flags})

    return df.select(group, key, points).groupBy(group).applyInPandas(scan, f"{key} long, kept boolean")


def tiers(df: DataFrame, group: str, key: str, low: str, high: str, n: int) -> DataFrame:
    """First-fit tiers of intervals, by falling start."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([low, key], ascending=[False, True])
        tier, forced = first_fit(pdf[low].to_numpy(float), pdf[high].to_numpy(float), n)
        return pd.DataFrame({group: pdf[group].to_numpy(), key: pdf[key].to_numpy(), "tier": tier.astype("int32"), "forced": forced})

    kinds = dict(df.dtypes)
    return df.select(group, key, low, high).groupBy(group).applyInPandas(scan, f"{group} {kinds[group]}, {key} {kinds[key]}, tier int, forced boolean")


def guard(df: DataFrame, group: str, key: str, order: str, value: str) -> DataFrame:
    """Strictly falling values: one that is not below the one before becomes that less 1."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, key])
        out, changed = monotonic_guard(pdf[value].to_numpy(float))
        return pd.DataFrame({group: pdf[group].to_numpy(), key: pdf[key].to_numpy(), value: out, "changed": changed})

    kinds = dict(df.dtypes)
    return df.select(group, key, order, value).groupBy(group).applyInPandas(scan, f"{group} {kinds[group]}, {key} {kinds[key]}, {value} double, changed boolean")


def clusters(df: DataFrame, group: str, key: str, x: str, y: str, weight: str, radius: float) -> DataFrame:
    """Heaviest first; a point joins the first cluster whose seed is nearer than ``radius``. Weighted centres, heaviest first."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([weight, key], ascending=[False, True])
        px, py = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        seeds: list[int] = []
        label = np.zeros(len(pdf), int)
        for i in range(len(pdf)):
            near = np.flatnonzero(np.hypot(px[seeds] - px[i], py[seeds] - py[i]) < radius) if seeds else []
            if len(near):
                label[i] = near[0]
            else:
                label[i] = len(seeds)
                seeds.append(i)
        w = pdf[weight].to_numpy(float)
        n = np.bincount(label, w)
        out = pd.DataFrame({group: pdf[group].iloc[0], "cx": np.bincount(label, px * w) / n, "cy": np.bincount(label, py * w) / n, "weight": n, "members": np.bincount(label)})
        return out.sort_values(["weight", "cx"], ascending=[False, True]).assign(cluster=np.arange(len(out), dtype="int32"))[[group, "cluster", "cx", "cy", "weight", "members"]]

    return df.select(group, key, x, y, weight).groupBy(group).applyInPandas(scan, f"{group} {dict(df.dtypes)[group]}, cluster int, cx double, cy double, weight double, members long")
