"""How tracks look: mean and typical vectors, distances of looks, tracks that change their look, groups of one look."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchweave.functions.kernels import average_linkage, density_clusters
from pitchweave.functions.vectors import cosine, dot

#: Vectors of a track that are looked at, typical vectors kept, vectors a track needs for these.
SAMPLE, MEDOIDS, LEAST = 500, 10, 3


def _sampled(views: DataFrame, keys: list[str], order: str, vector: str, sample: int) -> DataFrame:
    """At most about ``sample`` views of a track, drawn by hash, so that no track is a large group."""
    v = F.col(vector)
    rows = views.where(F.col(order).isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    rows = rows.select(*keys, F.col(order).cast("bigint").alias("k_"), v.cast("array<double>").alias("v_"))
    size = rows.groupBy(*keys).agg(F.count("*").alias("n_"))
    return rows.join(size, keys).where(F.pmod(F.xxhash64("k_", "v_"), F.lit(1 << 30)) < F.lit((1 << 30) * float(sample)) / F.col("n_")).drop("n_")


def _units(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    g = g.assign(t_=[tuple(v) for v in g["v_"]]).sort_values(["k_", "t_"])
    dim = len(g["v_"].iloc[0])
    x = np.array([v for v in g["v_"] if len(v) == dim], float)
    return g["k_"].to_numpy()[[len(v) == dim for v in g["v_"]]], x / np.linalg.norm(x, axis=1, keepdims=True)


def track_looks(views: DataFrame, *, keys: list[str], order: str, vector: str, sample: int = SAMPLE, most: int = MEDOIDS) -> DataFrame:
    """(keys, n, mean, medoids, spread): the mean of a track's unit vectors, and a typical one of each of up to ten stretches of time.

    A typical vector has the highest summed cosine to the others of its stretch; of equal ones the first.  ``spread`` is the mean
    cosine distance to the track's own most typical vector.  Tracks of under three usable vectors give no row.
    """
    rows = _sampled(views, keys, order, vector, sample)
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        _, x = _units(g)
        own = {k: g[k].iloc[:1].tolist() for k in keys}
        if len(x) < LEAST:
            return pd.DataFrame({**own, "n": [len(x)], "mean": [None], "medoids": [None], "spread": [None]})
        typical = [part[int(np.argmax(np.round((part @ part.T).sum(axis=1), 9)))] for part in np.array_split(x, min(most, len(x)))]
        centre = x[int(np.argmax(np.round((x @ x.T).sum(axis=1), 9)))]
        mean = x.mean(axis=0)
        return pd.DataFrame({**own, "n": [len(x)], "mean": [(mean / max(np.linalg.norm(mean), 1e-9)).tolist()], "medoids": [[m.tolist() for m in typical]], "spread": [float(1 - (x @ centre).mean())]})

    out = rows.groupBy(*keys).applyInPandas(kernel, f"{fields}, n bigint, mean array<double>, medoids array<array<double>>, spread double")
    return out.where("mean is not null")


def look_distance(mean_a: str, mean_b: str, medoids_a: str, medoids_b: str) -> Column:
    """Cosine distance of two looks, 0 to 2: that of the means or, if less, the 20th percentile of those between typical vectors; 0.5
    if one is missing."""
    pairs = F.flatten(F.transform(medoids_a, lambda a: F.transform(F.col(medoids_b), lambda b: 1 - dot(a, b))))
    ordered = F.array_sort(pairs)
    at = (F.size(ordered) - 1) * 0.2
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    percentile = low + (at - F.floor(at)) * (high - low)
    return F.coalesce(F.least(F.greatest(F.least(1 - cosine(F.col(mean_a), F.col(mean_b)), percentile), F.lit(0.0)), F.lit(2.0)), F.lit(0.5))


def look_changes(views: DataFrame, *, keys: list[str], order: str, vector: str, near: float = 0.15, least: int = 5, shortest: int = 10, sample: int = SAMPLE) -> DataFrame:
    """(keys, part, first, last, views): stretches of a track in which it looks alike; more than one where it changes its look.

    A track's vectors are clustered by density (cosine distance ``near``, ``least`` neighbours); each view belongs to the
    cluster of the nearest clustered one in time, and stretches of under ``shortest`` frames go to the longer one beside them.
    """
    rows = _sampled(views, keys, order, vector, sample)
    fields = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        k, x = _units(g)
        label = density_clusters(1 - x @ x.T, near, least)
        firm = np.flatnonzero(label >= 0)
        if len(firm):  # the nearest in time, of two equally near the later
            after = np.minimum(np.searchsorted(k[firm], k), len(firm) - 1)
            before = np.maximum(after - 1, 0)
            label = label[firm[np.where(np.abs(k[firm[before]] - k) < np.abs(k[firm[after]] - k), before, after)]]
        edges = [0, *(np.flatnonzero(np.diff(label)) + 1).tolist(), len(k)]
        parts = [[lo, hi, int(label[lo])] for lo, hi in zip(edges, edges[1:])]
        while len(parts) > 1:
            length = [k[hi - 1] - k[lo] + 1 for lo, hi, _ in parts]
            i = int(np.argmin(length))
            if length[i] >= shortest:
                break
            beside = [j for j in (i - 1, i + 1) if 0 <= j < len(parts)]
            j = max(beside, key=lambda j: length[j])
            parts[j] = [min(parts[i][0], parts[j][0]), max(parts[i][1], parts[j][1]), parts[j][2]]
            del parts[i]
            merged = [parts[0]]
            for p in parts[1:]:
                if p[2] == merged[-1][2]:
                    merged[-1][1] = p[1]
                else:
                    merged.append(p)
            parts = merged
        n = len(parts)
        return pd.DataFrame({**{c: [g[c].iloc[0]] * n for c in keys}, "part": range(n), "first": [int(k[lo]) for lo, _, _ in parts], "last": [int(k[hi - 1]) for _, hi, _ in parts], "views": [hi - lo for lo, hi, _ in parts]})

    return rows.groupBy(*keys).applyInPandas(kernel, f"{fields}, part int, first bigint, last bigint, views bigint")


def look_groups(looks: DataFrame, *, match: str, id: str, groups: int) -> DataFrame:
    """(match, id, look): the tracks of each match in at most ``groups`` groups of one look, by average linkage of their means.

    A match is one group: its tracks are those of one recording.  ``look`` is the smallest id of the group.
    """
    kinds = ", ".join(f"`{c}` {looks.schema[c].dataType.simpleString()}" for c in (match, id))

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(id)
        x = np.array(g["mean"].tolist(), float)
        label = average_linkage(1 - x @ x.T, groups)
        ids = g[id].to_numpy()
        first = {c: ids[label == c].min() for c in np.unique(label)}
        return pd.DataFrame({match: g[match], id: ids, "look": [first[c] for c in label]})

    return looks.select(match, id, "mean").groupBy(match).applyInPandas(kernel, f"{kinds}, look {looks.schema[id].dataType.simpleString()}")
