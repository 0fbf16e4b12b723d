"""Clusters of similar records by a Gaussian mixture.

All rows are standardised and reduced by principal components, and then
summarised once by cells of the reduced space: number, sum and sum of products
of the rows of a cell. Expectation maximisation runs on these summaries, whose
number is bounded by ``max_cells`` however many rows there are; the rows of a cell
share their membership among the components that are densest there, and both steps
use the exact sums, so that every row counts and what is maximised is a lower bound
of the rows' own likelihood, which no width of cells can raise above it. Assignment scores all rows in batches.

Scales are robust (by quartiles), so that a few far rows neither flatten the rest
nor fill its cells; cells are laid where rows are, as fine as their number allows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinage.operators.components import connected_components
from vicinage.session import cut_lineage


@dataclass(frozen=True)
class Mixture:
    """A fitted mixture and the way from features to its space."""

    features: tuple[str, ...]
    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray
    weights: np.ndarray
    centres: np.ndarray
    precisions: np.ndarray
    log_norms: np.ndarray
    criterion: dict[int, float]

    @property
    def size(self) -> int:
        return len(self.weights)

    @property
    def settled(self) -> bool:
        """Whether the criterion was seen to rise again beyond the chosen number."""
        return max(self.criterion) > self.size

    def assign(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Component (from 0) of the highest joint density of every row of features, and its logarithm."""
        z = np.clip((values - self.mean) / self.scale, -FAR, FAR) @ self.axes.T
        terms = np.concatenate([np.ones((len(z), 1)), z, (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)], 1)
        joint = terms @ _quadratic(self.weights, self.centres, self.precisions, self.log_norms).T
        best = joint.argmax(1)
        # rounded, so that equal rows are equal whatever stands beside them
        return best, joint[np.arange(len(z)), best].round(9)


def _quadratic(weights, centres, precisions, log_norms):
    """Coefficients of 1, z and z z' in the log joint density, one row per component."""
    pulled = np.einsum("kij,kj->ki", precisions, centres)
    constant = np.log(weights) + log_norms - (pulled * centres).sum(1) / 2
    return np.concatenate([constant[:, None], pulled, -precisions.reshape(len(weights), -1) / 2], 1)


def _standard(features: Sequence[str], mean: Sequence[float], scale: Sequence[float]) -> list[Column]:
    far = F.lit(FAR)
    return [F.greatest(F.least((F.col(f) - F.lit(float(m))) / F.lit(float(s)), far), -far) for f, m, s in zip(features, mean, scale)]


def _linear(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for c, w in zip(columns, weights):
        total = total + c * F.lit(float(w))
    return total


#: widths of cells that are tried, in deviations; the finest whose cells fit is taken
WIDTHS = tuple(2.0**-k for k in range(-3, 11))
#: components that may share a cell: those of highest joint density; looked for anew in these rounds, and when EM has settled
SHARERS, RENEWED = 32, frozenset({0, 1, 2, 4, 8, 16, 32, 64})
#: values further from the middle than so many robust deviations count as if there
FAR = 1e4


def _summaries(df: DataFrame, features: Sequence[str], explained: float, ridge: float, max_cells: int):
    """Standardisation, reduction and the cell summaries (at most ``max_cells`` rows).

    Cells need be no finer than half the deviation that the ridge leaves to a
    component without spread, as they then hide no component that the ridge
    allows; where that takes more than ``max_cells`` cells that hold rows, they
    are wider, and a warning says so if they exceed it. The number of cells held
    is estimated for all widths in one pass. Means and covariances count values
    beyond ``FAR`` robust deviations as lying there.
    """
    d = len(features)
    marks = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f, [0.25, 0.5, 0.75], 10_000).alias(f"q{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    if not marks["n"]:
        return None
    mean, scale = np.zeros(d), np.ones(d)
    for i in range(d):
        low, middle, high = marks[f"q{i}"]
        # quartiles of a normal variable are 1.349 deviations apart
        mean[i], spread = middle, (high - low) / 1.349
        scale[i] = spread if spread > 1e-9 * max(1.0, abs(middle)) else marks[f"s{i}"]
        if not scale[i] > 1e-12:
            scale[i] = 1.0
    standard = _standard(features, mean, scale)
    points = df.select(*[z.alias(f"u{i}") for i, z in enumerate(standard)])
    row = points.agg(*[F.covar_pop(f"u{i}", f"u{j}").alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)
    share = np.cumsum(values[order]) / max(values.sum(), 1e-300)
    keep = int(np.searchsorted(share, explained - 1e-12)) + 1
    axes = vectors[:, order[:keep]].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    r = len(axes)
    cells = points.select(*[_linear([F.col(f"u{i}") for i in range(d)], a).alias(f"z{k}") for k, a in enumerate(axes)])
    # what the driver receives is bounded in numbers, whatever the dimensions
    most = max(1, min(max_cells, 6_000_000 // (1 + r + r * (r + 1) // 2)))
    finest = np.sqrt(ridge) / 2
    widths = [w for w in WIDTHS if w > finest] + [float(finest)]
    at = lambda w: [F.floor(F.col(f"z{i}") / float(w)) for i in range(r)]
    held = cells.agg(*[F.approx_count_distinct(F.xxhash64(*at(w)), 0.02).alias(f"w{k}") for k, w in enumerate(widths)]).first()
    fitting = [w for k, w in enumerate(widths) if held[f"w{k}"] <= 0.9 * most]
    totals = [F.count(F.lit(1)).alias("n")] + [F.sum(f"z{i}").alias(f"s{i}") for i in range(r)]
    totals += [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}_{j}") for i in range(r) for j in range(i, r)]
    width = min(fitting, default=widths[0])
    keys = [k.alias(f"k{i}") for i, k in enumerate(at(width))]
    while True:
        # at most ``most`` rows of fixed width
        got = cells.groupBy(*keys).agg(*totals).orderBy(*[f"k{i}" for i in range(r)]).limit(most + 1).toPandas()
        if len(got) <= most:
            break
        width *= 2
        keys = [k.alias(f"k{i}") for i, k in enumerate(at(width))]
    if width > np.sqrt(ridge) and len(got) < marks["n"]:
        warnings.warn(f"cells are {width:.3g} deviations wide, more than the ridge: finer components can't be told apart", stacklevel=3)
    n = got["n"].to_numpy(float)
    first = got[[f"s{i}" for i in range(r)]].to_numpy(float)
    second = np.stack([np.stack([got[f"p{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in range(r)], 1) for i in range(r)], 1)
    return mean, scale, axes, n, first, second


def _normal(covariances):
    """Precisions and logarithms of the norms."""
    return np.linalg.inv(covariances), -0.5 * (covariances.shape[1] * np.log(2 * np.pi) + np.linalg.slogdet(covariances)[1])


def _sharers(terms, coefficients):
    """The ``SHARERS`` components of highest joint density of every cell."""
    block = max(1, 2_000_000 // len(coefficients))
    parts = [np.argpartition(terms[at : at + block] @ coefficients.T, -SHARERS, axis=1)[:, -SHARERS:].astype(np.int32) for at in range(0, len(terms), block)]
    return np.concatenate(parts)


def _expect(n, terms, moments, coefficients, sharers):
    """Log likelihood, and moments of every component; of all components, or of the ``sharers`` of every cell.

    Components that don't share a cell count as zero there, which leaves the
    likelihood a lower bound.
    """
    k, width = coefficients.shape
    # blocks bound the memory, whatever the numbers of cells and components
    block = max(1, 2_000_000 // (k if sharers is None else SHARERS * width))
    likelihood, sums = 0.0, np.zeros((k, width))
    for at in range(0, len(n), block):
        part = slice(at, at + block)
        joint = terms[part] @ coefficients.T if sharers is None else np.einsum("nsm,nm->ns", coefficients[sharers[part]], terms[part])
        top = joint.max(1, keepdims=True)
        share = np.exp(joint - top)
        norm = share.sum(1, keepdims=True)
        likelihood += float((n[part] * (top + np.log(norm))[:, 0]).sum())
        share /= norm
        if sharers is None:
            sums += share.T @ moments[part]
        else:
            whose = sharers[part].ravel()
            for m in range(width):
                sums[:, m] += np.bincount(whose, (share * moments[part, m, None]).ravel(), k)
    return likelihood, sums


def _fit(n, first, second, k, ridge, rounds, seed):
    """EM with ``k`` components on cell summaries; (log likelihood, parameters)."""
    d, total = first.shape[1], n.sum()
    points = first / n[:, None]
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(n), p=n / total))]
    nearest = ((points - points[chosen[0]]) ** 2).sum(1)
    for _ in range(k - 1):
        gap = nearest * n
        chosen.append(int(rng.choice(len(n), p=gap / gap.sum())) if gap.sum() > 0 else chosen[0])
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
    centres, weights = points[chosen].copy(), np.full(k, 1 / k)
    # far rows must not set the first spread: the middle of the distances to the chosen centres does
    middle = np.sort(nearest)[np.searchsorted(np.cumsum(n[np.argsort(nearest)]), total / 2)]
    covariances = np.repeat((np.eye(d) * max(middle, ridge))[None], k, 0)
    moments = np.concatenate([n[:, None], first, second.reshape(len(n), -1)], 1)
    # means over the rows of a cell of 1, z and z z': log densities are averaged exactly
    terms = moments / n[:, None]
    before, likelihood, sharers, renew = -np.inf, -np.inf, None, True
    for step in range(rounds):
        coefficients = _quadratic(weights, centres, *_normal(covariances))
        renewed = k > SHARERS and (renew or step in RENEWED)
        if renewed:
            sharers = _sharers(terms, coefficients)
        likelihood, sums = _expect(n, terms, moments, coefficients, sharers)
        mass = sums[:, 0] + 1e-9
        centres = sums[:, 1 : 1 + d] / mass[:, None]
        covariances = sums[:, 1 + d :].reshape(k, d, d) / mass[:, None, None] - np.einsum("ki,kj->kij", centres, centres)
        covariances = (covariances + covariances.transpose(0, 2, 1)) / 2 + ridge * np.eye(d)
        weights = mass / mass.sum()
        renew = likelihood - before < 1e-6 * total
        # settled, if it is so with the sharers of these parameters as well
        if renew and (renewed or k <= SHARERS):
            break
        before = likelihood
    return likelihood, weights, centres, covariances


def _ladder(most: int | None, cells: int) -> Iterator[int]:
    """1, 2, 4, 8, 12, 16, 24, 32, 48, .. up to ``most``; without it, up to the number of cells, and that number."""
    if most is None:
        yield from (k for k in _ladder(cells, cells) if k < cells)
        yield cells
        return
    yield from (k for k in (1, 2, 4) if k <= most)
    step = 8
    while step <= most:
        yield step
        if step * 3 // 2 <= most:
            yield step * 3 // 2
        step *= 2


def fit_mixture(
    df: DataFrame,
    features: Sequence[str],
    *,
    components: Sequence[int] | None = None,
    most: int | None = None,
    patience: int = 3,
    explained: float = 0.99,
    ridge: float = 1e-3,
    rounds: int = 100,
    starts: int = 2,
    max_cells: int = 262_144,
    seed: int = 3,
) -> Mixture | None:
    """The mixture whose number of components has the least Bayesian information criterion.

    The numbers 1, 2, 4, 8, 12, 16, 24, 32, 48, .. are tried until ``patience`` of
    them in a row don't improve on the best, or every cell has a component of its
    own. With ``most``, if the best is among the last before it, so that the
    criterion wasn't seen to rise again, it is an error. A given list of
    ``components`` is tried as it stands, with a warning if its last is the best
    (``settled`` tells). ``df`` must hold finite numbers in ``features``; all rows
    count. Of ``starts`` beginnings the one of the highest likelihood counts.
    ``None`` for an empty table. Four passes over the rows (quartiles, products,
    number of cells, cells); the driver receives at most ``max_cells`` summaries
    of fixed width.
    """
    summary = _summaries(df, features, explained, ridge, max_cells)
    if summary is None:
        return None
    mean, scale, axes, n, first, second = summary
    d, best, criterion, idle = first.shape[1], None, {}, 0
    for k in _ladder(most, len(n)) if components is None else sorted(set(components)):
        if k > len(n) or (components is None and idle == patience):
            break
        likelihood, weights, centres, covariances = max((_fit(n, first, second, k, ridge, rounds, seed + i) for i in range(starts if k > 1 else 1)), key=lambda x: x[0])
        free = k * (d + d * (d + 1) / 2) + k - 1
        criterion[k] = float(free * np.log(n.sum()) - 2 * likelihood)
        idle += 1
        if best is None or criterion[k] < best[0]:
            best, idle = (criterion[k], weights, centres, covariances), 0
    if idle == 0 and len(n) > max(criterion) > 1:
        said = f"the criterion still falls at {max(criterion)} components, the last number tried"
        if components is None and most is not None and 2 * max(criterion) > most:
            raise ValueError(said)
        warnings.warn(said, stacklevel=2)
    _, weights, centres, covariances = best
    precisions, log_norms = _normal(covariances)
    return Mixture(tuple(features), mean, scale, axes, weights, centres, precisions, log_norms, criterion)


def usable_points(df: DataFrame, item: str, features: Sequence[str], lowest: float | None, highest: float | None) -> DataFrame:
    """``item`` and features of the rows that count, one row per item.

    Null items, and features that are null, NaN, infinite or outside
    ``lowest..highest`` don't count; an item with several rows counts by the
    least of them.
    """
    columns = [f"f{i}" for i in range(len(features))]
    rows = df.select(df[item].alias("item"), *[df[f].cast("double").alias(c) for f, c in zip(features, columns)])
    keep = F.col("item").isNotNull()
    for c in columns:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        if lowest is not None:
            keep = keep & (F.col(c) >= lowest)
        if highest is not None:
            keep = keep & (F.col(c) <= highest)
    point = F.min(F.struct(*columns)).alias("p")
    return rows.filter(keep).groupBy("item").agg(point).select("item", *[F.col(f"p.{c}").alias(c) for c in columns])


def divide(points: DataFrame, mixture: Mixture) -> DataFrame:
    """``points`` with ``cluster_id`` (most probable component, from 1) and ``log_density``.

    Rows are scored in batches against all components, whose coefficients go along
    with the tasks.
    """
    features = list(mixture.features)
    # bounds the memory of a batch
    block = max(1, 4_000_000 // mixture.size)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), block):
                part = frame.iloc[at : at + block].copy()
                best, density = mixture.assign(part[features].to_numpy(float))
                part["cluster_id"], part["log_density"] = (best + 1).astype("int32"), density
                yield part

    kinds = ", ".join(f"`{n}` {t}" for n, t in points.dtypes)
    return points.mapInPandas(run, f"{kinds}, cluster_id int, log_density double")


def _empty_division(points: DataFrame) -> DataFrame:
    return points.withColumn("cluster_id", F.lit(None).cast("int")).withColumn("log_density", F.lit(None).cast("double"))


def mixture_clusters(df: DataFrame, *, item: str, features: Sequence[str], lowest: float | None = None, highest: float | None = None, **options) -> tuple[DataFrame, Mixture | None]:
    """Every usable item with its cluster: ``item``, ``f0``.., ``cluster_id``, ``log_density``; and the mixture.

    See :func:`usable_points` for the rows that count. Items with equal features
    get equal clusters. Other columns are ignored. Of an empty table the result
    is empty and there is no mixture.
    """
    points = cut_lineage(usable_points(df, item, features, lowest, highest))
    mixture = fit_mixture(points, [f"f{i}" for i in range(len(features))], **options)
    # written once, as every use of the clusters reads all rows
    return (points.transform(_empty_division) if mixture is None else cut_lineage(divide(points, mixture))), mixture


def describe_clusters(assigned: DataFrame, *, typical: int = 3) -> DataFrame:
    """``cluster_id``, ``cluster_size``, ``representative`` and ``typical_members``.

    The members of highest density represent a cluster; of equal ones, the
    smaller. They are kept by a bounded heap per cluster.
    """
    from vicinage.llm.top_n import bounded_heap

    heap = bounded_heap(F.struct((-F.col("log_density")).alias("low"), F.col("item").alias("item")), typical)
    grouped = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"), heap.alias("h"))
    return grouped.select("cluster_id", "cluster_size", F.element_at("h", 1)["item"].alias("representative"), F.transform("h", lambda x: x["item"]).alias("typical_members"))


#: grid cells per side of a tile; a tile holds at most TILE * TILE cells
TILE = 32


def _local_groups(frames: pd.DataFrame) -> pd.DataFrame:
    """Union of linked cells within one (cluster, tile); at most TILE * TILE cells."""
    tolerance = int(frames["tolerance"].iloc[0])
    where = {(int(x), int(y)): i for i, (x, y) in enumerate(zip(frames["cx"], frames["cy"]))}
    points = [np.array([(p["x"], p["low"], p["high"]) for p in ps], dtype=np.int64) for ps in frames["points"]]
    parent = list(range(len(points)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for (x, y), i in where.items():
        for dx, dy in ((1, 0), (1, 1), (1, -1), (0, 1)):
            j = where.get((x + dx, y + dy))
            if j is None or root(i) == root(j):
                continue
            a, b = points[i], points[j]
            near = np.abs(a[:, None, 0] - b[None, :, 0]) <= tolerance
            if dy > 0:
                near &= b[None, :, 1] - a[:, None, 2] <= tolerance
            elif dy < 0:
                near &= a[:, None, 1] - b[None, :, 2] <= tolerance
            if near.any():
                parent[max(root(i), root(j))] = min(root(i), root(j))
    keys = frames["cell"].to_numpy()
    label: dict[int, int] = {}
    for i, key in enumerate(keys):
        r = root(i)
        label[r] = min(label.get(r, int(key)), int(key))
    return pd.DataFrame({"cell": keys, "group": [label[root(i)] for i in range(len(keys))]})


def linked_groups(assigned: DataFrame, *, tolerance: float, resolution: float = 1e-6, least_size: int = 1) -> DataFrame:
    """Exact refinement of a division of points in the plane by linkage.

    Two items are linked if each feature (``f0``, ``f1``) differs by at most
    ``tolerance``; groups are the largest sets joined by links, within clusters
    and across their borders. Result: ``item``, ``group_key`` (smallest item) and
    ``group_size``, for groups of at least ``least_size`` items.

    Features are taken at the given ``resolution``. The plane is laid out in cells
    of the tolerance's side, whose points are linked whatever their number, and
    which hold at most ``tolerance / resolution`` (at most 10,000, checked)
    distinct first coordinates; for links to other cells the lowest and highest
    second coordinate at each of them suffice. Cells of one cluster are joined in
    tiles of bounded size; links between tiles and between clusters go to
    distributed connected components. Neither items nor links are collected.
    """
    steps = round(tolerance / resolution)
    if not 1 <= steps <= 10_000:
        raise ValueError("tolerance must be 1 to 10,000 times the resolution")
    unit = float(1 / resolution)
    rows = assigned.select("item", "cluster_id", F.round(F.col("f0") * unit).cast("long").alias("x"), F.round(F.col("f1") * unit).cast("long").alias("y"))
    rows = rows.withColumn("cx", F.floor(F.col("x") / steps)).withColumn("cy", F.floor(F.col("y") / steps))
    place = ["cluster_id", "cx", "cy"]
    by_x = rows.groupBy(*place, "x").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count(F.lit(1)).alias("n"), F.min("item").alias("least"))
    cells = by_x.groupBy(*place).agg(F.collect_list(F.struct("x", "low", "high")).alias("points"), F.sum("n").alias("n"), F.min("least").alias("least"))
    # written with their numbers, which are drawn once
    cells = cut_lineage(cells.withColumn("cell", F.monotonically_increasing_id()).withColumn("tx", F.floor(F.col("cx") / TILE)).withColumn("ty", F.floor(F.col("cy") / TILE)).withColumn("tolerance", F.lit(steps)))
    local = cells.groupBy("cluster_id", "tx", "ty").applyInPandas(_local_groups, "cell long, group long")
    grouped = cut_lineage(cells.join(local, "cell"))
    # links between blocks: a cell looks ahead to four neighbours and to itself under other clusters
    ahead = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (1, 1), (1, -1), (0, 1), (0, 0))])
    here = grouped.select("group", "cluster_id", "tx", "ty", "cx", "cy", "points", F.explode(ahead).alias("o"))
    here = here.select("group", "cluster_id", "tx", "ty", "points", F.col("o.dy").alias("dy"), (F.col("cx") + F.col("o.dx")).alias("cx"), (F.col("cy") + F.col("o.dy")).alias("cy"))
    there = grouped.select(F.col("group").alias("group_2"), F.col("cluster_id").alias("cluster_2"), F.col("tx").alias("tx_2"), F.col("ty").alias("ty_2"), "cx", "cy", F.col("points").alias("points_2"))
    other_block = (F.col("cluster_id") != F.col("cluster_2")) | (F.col("tx") != F.col("tx_2")) | (F.col("ty") != F.col("ty_2"))

    def near(p: Column, q: Column) -> Column:
        in_y = F.when(F.col("dy") > 0, q["low"] - p["high"] <= steps).when(F.col("dy") < 0, p["low"] - q["high"] <= steps).otherwise(F.lit(True))
        return (F.abs(p["x"] - q["x"]) <= steps) & in_y

    linked = F.exists("points", lambda p: F.exists("points_2", lambda q: near(p, q)))
    met = here.join(there, ["cx", "cy"]).filter(other_block & (F.col("group") != F.col("group_2"))).filter(linked)
    joined = connected_components(met.select("group", "group_2").distinct(), left="group", right="group_2")
    final = grouped.join(joined.withColumnRenamed("node", "group"), "group", "left").withColumn("final", F.coalesce("component", "group"))
    sizes = final.groupBy("final").agg(F.sum("n").alias("group_size"), F.min("least").alias("group_key")).filter(F.col("group_size") >= least_size)
    of_cell = final.join(sizes, "final").select(*place, "group_key", "group_size")
    return rows.select("item", *place).join(of_cell, place).select("item", "group_key", "group_size")
