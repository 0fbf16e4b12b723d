"""Average-linkage clustering, silhouettes and scaling of small cohorts.

These need the whole distance matrix of a cohort at once. The cohort is limited
(checked); a group of distances is handed to one NumPy task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ENTITIES = 2_500


def average_linkage(distance: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, height) of average linkage; new clusters are numbered from n on.

    Of equal heights the pair with the smaller cluster numbers merges first.
    """
    n = len(distance)
    work = distance.astype(float).copy()
    np.fill_diagonal(work, np.inf)
    label, size, alive, merges = list(range(n)), [1] * n, np.ones(n, dtype=bool), []
    for step in range(n - 1):
        low = work.min()
        rows, cols = np.nonzero(work <= low + 1e-12)
        at = min(((min(label[i], label[j]), max(label[i], label[j]), i, j) for i, j in zip(rows, cols) if i < j))
        i, j = at[2], at[3]
        merges.append((at[0], at[1], float(low)))
        mixed = (size[i] * work[i] + size[j] * work[j]) / (size[i] + size[j])
        work[i], work[:, i] = mixed, mixed
        work[j], work[:, j], work[i, i] = np.inf, np.inf, np.inf
        alive[j] = False
        work[i, ~alive], work[~alive, i] = np.inf, np.inf
        label[i], size[i] = n + step, size[i] + size[j]
    return merges


def cut(merges: list[tuple[int, int, float]], n: int, k: int) -> np.ndarray:
    """Labels (from 1, by first member) when the last merges are undone to leave ``k`` clusters."""
    parent = list(range(2 * n))
    for step, (a, b, _) in enumerate(merges[: n - k]):
        parent[a] = parent[b] = n + step

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    seen: dict[int, int] = {}
    return np.array([seen.setdefault(root(i), len(seen) + 1) for i in range(n)])


def silhouette(distance: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; lone members count 0."""
    groups = np.unique(labels)
    means = np.stack([distance[:, labels == g].sum(1) for g in groups], 1)
    sizes = np.array([(labels == g).sum() for g in groups])
    own = np.searchsorted(groups, labels)
    rows = np.arange(len(labels))
    inner = means[rows, own] / np.maximum(sizes[own] - 1, 1)
    outer = means / sizes
    outer[rows, own] = np.inf
    other = outer.min(1)
    top = np.maximum(inner, other)
    value = np.where((sizes[own] > 1) & (top > 0), (other - inner) / np.where(top > 0, top, 1), 0.0)
    return float(value.mean())


def choose_clusters(distance: np.ndarray, k: int | None = None, most: int = 8) -> tuple[np.ndarray, list[tuple[int, float]]]:
    """Labels for a fixed number of clusters, or for the best silhouette among 2 to ``most`` (the smallest of equals)."""
    n = len(distance)
    if n < 3 and k is None:
        return np.ones(n, dtype=int), []
    merges = average_linkage(distance)
    if k is not None:
        return cut(merges, n, max(1, min(k, n))), []
    tried, best = [], None
    for size in range(2, min(most, n - 1) + 1):
        labels = cut(merges, n, size)
        score = silhouette(distance, labels)
        tried.append((size, score))
        if best is None or score > best[0]:
            best = (score, labels)
    return best[1], tried


def classical_scaling(distance: np.ndarray, dimensions: int = 2) -> np.ndarray:
    """Torgerson scaling; each axis is turned so that its largest entry is positive."""
    n = len(distance)
    centre = np.eye(n) - np.ones((n, n)) / n
    values, vectors = np.linalg.eigh(-0.5 * centre @ (distance**2) @ centre)
    order = np.argsort(-values)[:dimensions]
    axes = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    out = np.zeros((n, dimensions))
    out[:, : axes.shape[1]] = axes * np.where(signs == 0, 1, signs)
    return out


def _matrix(rows: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    ids = sorted(set(rows["id"]) | set(rows["other"]))
    at = {x: i for i, x in enumerate(ids)}
    out = np.ones((len(ids), len(ids)))
    np.fill_diagonal(out, 0.0)
    out[rows["id"].map(at), rows["other"].map(at)] = 1.0 - rows["similarity"]
    return ids, (out + out.T) / 2


def _checked(long: DataFrame) -> DataFrame:
    if long.select("id").distinct().limit(MAX_ENTITIES + 1).count() > MAX_ENTITIES:
        raise ValueError(f"exact clustering is limited to {MAX_ENTITIES} entities")
    return long.select(F.lit(1).alias("cohort"), "id", "other", "similarity")


def cluster_cohort(long: DataFrame, *, k: int | None = None, most: int = 8) -> DataFrame:
    """``id``, ``cluster_id`` of a cohort given as symmetric similarities (``id``, ``other``, ``similarity``)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, distance = _matrix(rows)
        labels, _ = choose_clusters(distance, k, most)
        return pd.DataFrame({"id": ids, "cluster_id": labels.astype(int)})

    return _checked(long).groupBy("cohort").applyInPandas(run, "id string, cluster_id int")


def scale_cohort(long: DataFrame) -> DataFrame:
    """``id``, ``x``, ``y``: two-dimensional coordinates of a cohort."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, distance = _matrix(rows)
        xy = classical_scaling(distance)
        return pd.DataFrame({"id": ids, "x": xy[:, 0], "y": xy[:, 1]})

    return _checked(long).groupBy("cohort").applyInPandas(run, "id string, x double, y double")
