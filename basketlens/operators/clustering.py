"""Customer clusters: K-means, Ward merges over micro-clusters, profiles and labels."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import presets
from ..functions.scalars import mean_of, ratio, total_of
from ..session import temporary, written
from ..sources.readers import numeric_summary
from .common import join_on_keys
from .features import group_shares
from .rank import summarise
from .rfm import crosstab

FEATURES, SCALED = "features", "scaled"
MICRO_CLUSTERS = 500
# Moves of every start, and of the best start of each k.
ITERATIONS, MAX_ITERATIONS = 10, 100
# Candidates that a round adds (about), and rounds.
OVERSAMPLE, ROUNDS = 100, 5
# The ladder of restarts.
RESTARTS = (1, 5, 10, 25, 50, 100)


# --------------------------------------------------------------------------- input


def missing_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and missing values over all the columns."""
    missing = [F.col(c).isNull() for c in columns]
    return df.agg(
        F.count(F.lit(1)).alias("Customers"),
        F.sum(sum((m.cast("int") for m in missing), F.lit(0))).alias("Missing_Values"),
    )


def cluster_matrix(customers: DataFrame, variables: Sequence[str] = tuple(presets.CLUSTER_VARIABLES)) -> DataFrame:
    """The frame plus a vector of the cluster variables; a missing value fails the job."""
    doubles = customers.withColumns({f"__{v}": F.col(v).cast("double") for v in variables})
    assembled = VectorAssembler(inputCols=[f"__{v}" for v in variables], outputCol=FEATURES, handleInvalid="error")
    return assembled.transform(doubles).drop(*[f"__{v}" for v in variables])


def standardise(matrix: DataFrame) -> DataFrame:
    """Vectors centred and divided by the sample deviation."""
    scaler = StandardScaler(inputCol=FEATURES, outputCol=SCALED, withMean=True, withStd=True)
    return scaler.fit(matrix).transform(matrix)


def scaled_summary(scaled: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Min, quartiles, mean, max, deviation of every scaled variable."""
    x = vector_to_array(SCALED)
    return numeric_summary(scaled.select(*[F.get(x, F.lit(i)).alias(v) for i, v in enumerate(variables)]), list(variables))


def total_sum_of_squares(scaled: DataFrame, dimensions: int) -> float:
    """Squared distance to the mean, summed: the within sum of squares of one cluster."""
    x = scaled.select(vector_to_array(SCALED).alias("x"))
    row = x.agg(*[F.var_pop(F.get("x", F.lit(i))).alias(f"v{i}") for i in range(dimensions)], F.count("x").alias("n")).first()
    return float(sum(row[f"v{i}"] for i in range(dimensions)) * row["n"])


# --------------------------------------------------------------------------- K-means


@dataclass(frozen=True)
class KMeansFit:
    """Centres of one start and its within sum of squares."""

    centres: np.ndarray
    cost: float
    sizes: np.ndarray


def _points(scaled: DataFrame) -> DataFrame:
    """The vectors alone, written, each with a number of its own."""
    return written(scaled.select(vector_to_array(SCALED).alias("x"), F.monotonically_increasing_id().alias("id")))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre of each row."""
    best = ((centres * centres).sum(1)[None] - 2.0 * x @ centres.T).argmin(1)
    return best, ((x - centres[best]) ** 2).sum(1)


BLOCK_ROWS = 2_048


def _assign_all(points: DataFrame, starts: Mapping[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """One pass over the rows for all starts: start -> (sums per cluster, sizes, cost).

    The centres of all starts are stacked, so that a block of rows meets them in one product. Each task sends one row per start
    and cluster; they are added up before they reach the driver, so what it sees is as large as the centres.
    """
    stacked = np.vstack(list(starts.values()))
    ends = np.cumsum([len(c) for c in starts.values()])
    spans = [slice(e - len(c), e) for e, c in zip(ends, starts.values())]
    half = (stacked * stacked).sum(1) / 2
    width = stacked.shape[1] + 2

    def run(batches):
        totals = np.zeros((len(stacked), width))
        for batch in batches:
            rows = _matrix(batch)
            for k in range(0, len(rows), BLOCK_ROWS):
                x = rows[k : k + BLOCK_ROWS]
                near = half[None] - x @ stacked.T
                for span in spans:
                    best = near[:, span].argmin(1)
                    centres = stacked[span]
                    squared = ((x - centres[best]) ** 2).sum(1)
                    member = (best[None] == np.arange(len(centres))[:, None]).astype(float)
                    totals[span] += member @ np.column_stack([x, np.ones(len(x)), squared])
        used = np.flatnonzero(totals[:, -2])
        yield pa.record_batch([pa.array(used, pa.int32()), pa.FixedSizeListArray.from_arrays(
            pa.array(totals[used].ravel()), width).cast(pa.list_(pa.float64()))], names=["centre", "v"])

    parts = points.select("x").mapInArrow(run, "centre int, v array<double>")
    added = parts.groupBy("centre").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("v"))
    totals = np.zeros((len(stacked), width))
    for r in added.collect():
        totals[r["centre"]] = r["v"]
    return {s: (totals[span, :-2], totals[span, -2], float(totals[span, -1].sum())) for s, span in zip(starts, spans)}


def _drawn(points: DataFrame, centres: np.ndarray, expected: float, before: float | None, turn: int) -> tuple[np.ndarray, float]:
    """Rows drawn with a chance of ``expected`` times their share of the cost ``before``, and the cost of the centres."""

    def run(batches):
        cost, found = 0.0, []
        for batch in batches:
            rows, ids = _matrix(batch), batch["id"].to_numpy().astype(np.uint64)
            for k in range(0, len(rows), BLOCK_ROWS):
                x = rows[k : k + BLOCK_ROWS]
                squared = _nearest(x, centres)[1]
                cost += float(squared.sum())
                if before:
                    chance = _uniform(ids[k : k + BLOCK_ROWS], turn)
                    found += x[chance * before < expected * squared].tolist()
        yield pa.record_batch([pa.array([None, *found], pa.list_(pa.float64())), pa.array([cost, *[0.0] * len(found)])], names=["x", "cost"])

    got = points.mapInArrow(run, "x array<double>, cost double")
    cost, rows = got.groupBy(F.col("x").isNull()).agg(F.sum("cost").alias("cost"), F.collect_set("x").alias("x")).orderBy(F.desc("cost")), []
    collected = cost.collect()
    for r in collected:
        rows += r["x"]
    return np.array(sorted(rows), dtype=float).reshape(-1, centres.shape[1]), sum(r["cost"] for r in collected)


def _uniform(ids: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on an id and a turn."""
    h = (ids + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
    for _ in range(2):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(11)).astype(float) / float(1 << 53)


@dataclass(frozen=True)
class Candidates:
    """Rows that starts are reduced from, and how many rows each is the nearest of."""

    rows: np.ndarray
    weights: np.ndarray


def candidates(points: DataFrame, largest: int, oversample: int = OVERSAMPLE, rounds: int = ROUNDS) -> Candidates:
    """Candidates for starts by oversampling rounds over all rows (k-means||).

    A round draws every row with a chance in proportion to its squared distance to the candidates so far, about ``oversample`` in
    all, so that a few rows far off from the rest are found among any number. Rounds go on until there are as many candidates as
    the largest k needs, or no row is left beside them. The driver sees the candidates, whose number the parameters set.
    """
    first = points.agg(F.min_by("x", F.struct(F.xxhash64("x", "id"), "id")).alias("x")).first()["x"]
    if first is None:
        raise ValueError("no rows to cluster")
    rows, before, turn = np.array([first], dtype=float), None, 0
    expected = float(max(oversample, 2 * largest))
    while True:
        drawn, cost = _drawn(points, rows, expected, before, turn)
        if before is not None:
            rows = np.unique(np.vstack([rows, drawn]), axis=0)
        if cost == 0.0 or (turn >= rounds and len(rows) >= largest):
            break
        before, turn = cost, turn + 1
    return Candidates(rows, _assign_all(points, {0: rows})[0][1])


def _reduced(found: Candidates, k: int, seed: int, turns: int = 100) -> np.ndarray:
    """k centres from the weighted candidates: seeded draws by weighted squared distance, then weighted moves."""
    rows, weights = found.rows, found.weights
    if k >= len(rows):
        return rows
    rng = np.random.Generator(np.random.PCG64(seed))
    chosen = [int(rng.choice(len(rows), p=weights / weights.sum()))]
    squared = ((rows - rows[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k:
        mass = weights * squared
        chosen.append(int(rng.choice(len(rows), p=mass / mass.sum() if mass.sum() > 0 else (squared > 0) / (squared > 0).sum())))
        squared = np.minimum(squared, ((rows - rows[chosen[-1]]) ** 2).sum(1))
    centres = rows[chosen]
    for _ in range(turns):
        member = (_nearest(rows, centres)[0][None] == np.arange(k)[:, None]) * weights
        sizes = member.sum(1)
        moved = np.where(sizes[:, None] > 0, member @ rows / np.maximum(sizes, 1e-300)[:, None], centres)
        if np.allclose(moved, centres, rtol=0.0, atol=1e-12):
            break
        centres = moved
    return centres


def _distinct(now: Mapping[int, np.ndarray]) -> dict[int, int]:
    """Start -> the first start with the same centres in any order."""
    seen: dict[tuple, int] = {}
    return {s: seen.setdefault(tuple(map(tuple, np.round(c[np.lexsort(np.round(c, 9).T[::-1])], 9).tolist())), s) for s, c in now.items()}


def lloyd(points: DataFrame, centres: Sequence[np.ndarray], max_iter: int = MAX_ITERATIONS) -> list[KMeansFit]:
    """Lloyd iterations of all starts together: one pass over the rows moves the centres of every start that still moves. Starts
    that have come to the same centres go on as one, since all that follows is the same."""
    now, done, same = dict(enumerate(centres)), {}, {}
    for turn in range(max_iter + 1):
        for s, first in _distinct(now).items():
            if s != first:
                same[s] = first
                del now[s]
        for s, (sums, sizes, cost) in _assign_all(points, now).items():
            moved = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1.0)[:, None], now[s])
            if turn == max_iter or np.allclose(moved, now[s], rtol=0.0, atol=1e-12):
                done[s] = KMeansFit(now.pop(s), cost, sizes)
            else:
                now[s] = moved
        if not now:
            break
    for s in sorted(same):
        first = s
        while first in same:
            first = same[first]
        done[s] = done[first]
    return [done[s] for s in range(len(centres))]


def moves_from(scaled: DataFrame, centres: Sequence[np.ndarray], moves: int) -> DataFrame:
    """So many moves from given centres: per cluster its size, its centre (a row per variable) and its sum of squares."""
    with temporary(scaled.sparkSession):
        points, now = _points(scaled), np.array(centres, dtype=float)
        for _ in range(moves):
            sums, sizes, _ = _assign_all(points, {0: now})[0]
            now = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1.0)[:, None], now)
        each = points.select(nearest_of_arrays(now)(F.col("x")).alias("near"))
        spread = each.groupBy("near.cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("near.squared").alias("ss")).collect()
    rows = [(r["cluster"] + 1, r["n"], float(c), r["ss"]) for r in spread for c in now[r["cluster"]]]
    return scaled.sparkSession.createDataFrame(rows, "Cluster int, Customers long, Centre double, Within_SS double")


def nearest_of_arrays(centres: np.ndarray) -> Callable[[Column], Column]:
    """A column function: number (from 0) of the centre nearest to an array, and its squared distance."""

    @F.pandas_udf("cluster int, squared double")
    def number(x: pd.Series) -> pd.DataFrame:
        best, squared = _nearest(np.stack(x.to_numpy()), centres) if len(x) else (np.empty(0), np.empty(0))
        return pd.DataFrame({"cluster": best.astype("int32"), "squared": squared})

    return number


def run_starts(scaled: DataFrame, fits: Sequence[tuple[int, int]], iterations: int = ITERATIONS,
               max_iter: int = MAX_ITERATIONS) -> list[KMeansFit]:
    """A fit for every (k, seed) pair, all in the same passes.

    Every start is reduced from the same candidates by its own seed and moves up to ``iterations`` times; the best of each k goes
    on until it rests, up to ``max_iter`` times.
    """
    with temporary(scaled.sparkSession):
        points = _points(scaled)
        found = candidates(points, max(k for k, _ in fits))
        out = lloyd(points, [_reduced(found, k, seed) for k, seed in fits], iterations)
        best = {k: min((i for i, f in enumerate(fits) if f[0] == k), key=lambda i: out[i].cost) for k, _ in fits}
        for i, fit in zip(best.values(), lloyd(points, [out[i].centres for i in best.values()], max_iter)):
            out[i] = fit
    return out


def kmeans_best_of(scaled: DataFrame, k: int, starts: int, seed: int = 1, max_iter: int = MAX_ITERATIONS) -> tuple[KMeansFit, float]:
    """Best of several seeded starts."""
    fits = run_starts(scaled, [(k, seed + i) for i in range(starts)], max_iter=max_iter)
    best = min(fits, key=lambda f: f.cost)
    return best, best.cost


def elbow(scaled: DataFrame, dimensions: int, k_values: Sequence[int] = tuple(range(1, 11)), starts: int = 25, seed: int = 1) -> DataFrame:
    """Within sum of squares per k, with the absolute and relative reduction to the k before."""
    fits = [(k, seed + i) for k in k_values if k > 1 for i in range(starts)]
    best: dict[int, float] = {1: total_sum_of_squares(scaled, dimensions)}
    for (k, _), fit in zip(fits, run_starts(scaled, fits)):
        best[k] = min(best.get(k, float("inf")), fit.cost)
    rows = [(int(k), float(best[k])) for k in k_values]
    table = scaled.sparkSession.createDataFrame(rows, "K int, Total_Within_SS double")
    before = F.lag("Total_Within_SS").over(W.orderBy("K"))
    return table.select(
        "K", "Total_Within_SS", (before - F.col("Total_Within_SS")).alias("WSS_Reduction"),
        ratio(before - F.col("Total_Within_SS"), before).alias("Percent_Reduction"))


FIT_SCHEMA = "Total_Within_SS double, Between_SS double, Total_SS double, Between_SS_Ratio double"


def _fit_row(wss: float, tss: float) -> tuple[float, float, float, float]:
    return float(wss), float(tss - wss), float(tss), float((tss - wss) / tss)


def restart_stability(scaled: DataFrame, dimensions: int, k: int = 4, restarts: Sequence[int] = RESTARTS, seed: int = 1) -> DataFrame:
    """Fit quality by number of starts. The starts are nested, so max(restarts) fits cover the ladder."""
    tss = total_sum_of_squares(scaled, dimensions)
    fits = run_starts(scaled, [(k, seed + i) for i in range(max(restarts))])
    running_best = np.minimum.accumulate([f.cost for f in fits])
    rows = [(int(n), *_fit_row(running_best[n - 1], tss)) for n in restarts]
    return scaled.sparkSession.createDataFrame(rows, "Nstart int, " + FIT_SCHEMA)


def fit_summary(spark: SparkSession, k: int, wss: float, tss: float) -> DataFrame:
    return spark.createDataFrame([(k, *_fit_row(wss, tss))], "K int, " + FIT_SCHEMA)


def nearest_centre(centres: np.ndarray) -> Callable[[Column], Column]:
    """A column function: number (from 0) of the centre nearest to a vector."""

    @F.pandas_udf("int")
    def number(x: pd.Series) -> pd.Series:
        return pd.Series(_nearest(np.stack(x.to_numpy()), centres)[0].astype("int32") if len(x) else [], dtype="int32")

    return lambda vector: number(vector_to_array(vector))


def attach_clusters(scaled: DataFrame, fit: KMeansFit, out: str = "KMeans_Cluster") -> DataFrame:
    """Cluster number 1..k per row, numbered by the fit's centres."""
    return scaled.withColumn(out, nearest_centre(fit.centres)(F.col(SCALED)) + 1)


def fit_check(clustered: DataFrame, fit: KMeansFit, dimensions: int) -> DataFrame:
    """What must hold for a converged fit whatever its seed: members nearest to their own centre, centres at the mean of their
    members, sums of squares that add up."""
    x = clustered.select("KMeans_Cluster", *[F.get(vector_to_array(SCALED), F.lit(i)).alias(f"x{i}") for i in range(dimensions)])
    names = [f"x{i}" for i in range(dimensions)]
    groups = x.groupBy("KMeans_Cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.var_pop(c).alias(f"v_{c}") for c in names])
    within = F.sum(F.col("n") * sum((F.col(f"v_{c}") for c in names), F.lit(0.0)))
    between = F.sum(F.col("n") * sum((F.col(f"m_{c}") * F.col(f"m_{c}") for c in names), F.lit(0.0)))
    total = total_sum_of_squares(clustered, dimensions)
    centres = clustered.sparkSession.createDataFrame(
        [(i + 1, [float(v) for v in c]) for i, c in enumerate(fit.centres)], "cluster int, centre array<double>")
    off = sum((F.abs(F.col(f"m_{c}") - F.get("centre", F.lit(i))) for i, c in enumerate(names)), F.lit(0.0))
    checked = groups.join(centres, F.col("KMeans_Cluster") == F.col("cluster"))
    return checked.agg(
        F.sum("n").alias("Customers"), F.count(F.lit(1)).alias("Clusters"), F.lit(total).alias("Total_SS"),
        (within + between - F.lit(total)).alias("SS_Gap"), (within - F.lit(fit.cost)).alias("Cost_Gap"), F.max(off).alias("Off_Centre"))


def renumber_by_value(clustered: DataFrame, cluster: str = "KMeans_Cluster", value: str = "Monetary") -> DataFrame:
    """Number clusters 1.. by falling mean value, so numbers do not depend on the seed."""
    order = clustered.groupBy(cluster).agg(mean_of(F.col(value)).alias("__m")).select(
        cluster, F.row_number().over(W.orderBy(F.desc("__m"), cluster)).alias("__new"))
    return clustered.join(order, cluster).withColumn(cluster, F.col("__new")).drop("__new")


# --------------------------------------------------------------------------- Ward


@dataclass(frozen=True)
class WardTree:
    """Merge history over micro-clusters: pairs in merge order, heights, and their sizes.

    ``inside`` is the sum of squares inside the micro-clusters, which the tree does not see: half the squared heights and it add
    up to the total. ``radius`` bounds the distance of a row to the row its micro-cluster began with; 0 means equal rows only,
    and then the tree is that of all rows.
    """

    centroids: np.ndarray
    sizes: np.ndarray
    merges: list[tuple[int, int, float]]
    inside: float = 0.0
    radius: float = 0.0

    def cut(self, k: int) -> list[int]:
        """Cluster number 1..k of each micro-cluster, numbered by first appearance."""
        m = len(self.sizes)
        parent = list(range(2 * m - 1))
        for step, (a, b, _) in enumerate(self.merges[: max(m - k, 0)]):
            parent[a] = parent[b] = m + step
        roots = []
        for i in range(m):
            while parent[i] != i:
                i = parent[i]
            roots.append(i)
        numbers = {r: n + 1 for n, r in enumerate(dict.fromkeys(roots))}
        return [numbers[r] for r in roots]

    def heights(self, spark: SparkSession) -> DataFrame:
        rows = [(i + 1, int(a), int(b), float(h)) for i, (a, b, h) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "step int, left_id int, right_id int, height double")


def ward_merges(centroids: np.ndarray, sizes: np.ndarray) -> WardTree:
    """Ward merges of weighted points: cost sqrt(2ab/(a+b)) times the centre distance.

    Follows chains of nearest neighbours: two that are each other's nearest are merged at once, which gives the same tree as
    always merging the closest pair, without a matrix of all pairs.
    """
    m = len(sizes)
    centre, weight = centroids.astype(float).copy(), sizes.astype(float).copy()
    name, alive = np.arange(m), np.ones(m, bool)
    found: list[tuple[int, int, float, float]] = []  # names, cost, place in the order: never before its parts
    level = [0.0] * m
    chain: list[int] = []
    while len(found) < m - 1:
        if not chain:
            chain = [int(np.argmax(alive))]
        top = chain[-1]
        cost = ((centre - centre[top]) ** 2).sum(1) * (2 * weight * weight[top] / (weight + weight[top]))
        cost[~alive] = np.inf
        cost[top] = np.inf
        near = int(np.argmin(cost))
        if len(chain) > 1 and cost[chain[-2]] <= cost[near]:
            near = chain[-2]  # of equal ones the one before, or the chain would not end
            chain = chain[:-2]
            a, b = min(top, near), max(top, near)
            place = max(float(cost[near]), level[name[a]], level[name[b]])
            found.append((int(name[a]), int(name[b]), float(cost[near]), place))
            level.append(place)
            centre[a] = (weight[a] * centre[a] + weight[b] * centre[b]) / (weight[a] + weight[b])
            weight[a] += weight[b]
            alive[b] = False
            name[a] = m + len(found) - 1
        else:
            chain.append(near)
    order = sorted(range(len(found)), key=lambda i: found[i][3])
    number = {m + i: m + k for k, i in enumerate(order)}
    merges = []
    for i in order:
        a, b = sorted(number.get(x, x) for x in found[i][:2])
        merges.append((a, b, float(np.sqrt(max(found[i][2], 0.0)))))
    return WardTree(centroids, sizes, merges)


def _condensed(leaders: np.ndarray, radii: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
    """Leaders that are farther apart than ``within``, and how far the rows behind them may be off."""
    kept, reach = [], []
    rest, r = leaders, radii
    while len(rest):
        gap = np.sqrt(((rest - rest[0]) ** 2).sum(1))
        near = gap <= within
        kept.append(rest[0])
        reach.append(float((gap[near] + r[near]).max()))
        rest, r = rest[~near], r[~near]
    return np.array(kept).reshape(-1, leaders.shape[1]), np.array(reach)


def _fitted(leaders: np.ndarray, radii: np.ndarray, within: float, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """At most ``most`` leaders: while there are more, those closer than usual for neighbours are joined."""
    while len(leaders) > most:
        some = np.linspace(0, len(leaders) - 1, min(256, len(leaders))).astype(int)
        gaps = ((leaders * leaders).sum(1)[None] - 2.0 * leaders[some] @ leaders.T + (leaders[some] ** 2).sum(1)[:, None])
        gaps[np.arange(len(some)), some] = np.inf
        usual = np.sort(np.sqrt(np.maximum(gaps.min(1), 0.0)))
        # about two leaders become one where they are closer than that
        share = min(1.0, 2.0 * (1.0 - most / len(leaders)))
        within = max(1.1 * within, float(usual[min(len(usual) - 1, int(share * len(usual)))]), 1e-300)
        leaders, radii = _condensed(leaders, radii, within)
    return leaders, radii, within


def micro_leaders(points: DataFrame, most: int, within: float = 0.0, per_task: int = 2) -> tuple[np.ndarray, float]:
    """Leaders of micro-clusters: at most ``most`` rows, and a bound on the distance of any row to the nearest.

    Every task keeps the features of its own rows: a row farther than the joining distance from all leaders becomes one, and with
    more than ``per_task * most`` of them the distance is raised and the leaders are joined. The tasks' leaders are joined in the
    same way in groups, until the driver gets a few times ``most`` of them.
    """
    limit = per_task * most

    def gather(batches):
        leaders, radii, joined = None, np.empty(0), within
        for batch in batches:
            for x in np.array_split(_matrix(batch), max(1, batch.num_rows // BLOCK_ROWS)):
                x = np.unique(x, axis=0)
                if leaders is None:
                    leaders = np.empty((0, x.shape[1]))
                if len(leaders):
                    off = np.sqrt(_nearest(x, leaders)[1])
                    best = _nearest(x, leaders)[0]
                    np.maximum.at(radii, best[off <= joined], off[off <= joined])
                    x = x[off > joined]
                more, reach = _condensed(x, np.zeros(len(x)), joined) if joined > 0 else (x, np.zeros(len(x)))
                leaders, radii, joined = _fitted(np.vstack([leaders, more]), np.concatenate([radii, reach]), joined, limit)
        if leaders is not None and len(leaders):
            yield pa.record_batch([pa.array(leaders.tolist(), pa.list_(pa.float64())), pa.array(radii), pa.array([joined] * len(leaders))],
                                  names=["x", "radius", "joined"])

    schema = "x array<double>, radius double, joined double"
    parts = written(points.select("x").mapInArrow(gather, schema))
    while (count := parts.count()) > 2 * limit:
        def join(rows: pd.DataFrame) -> pd.DataFrame:
            x, r, joined = _fitted(np.stack(rows["x"].to_numpy()), rows["radius"].to_numpy(), float(rows["joined"].max()), most)
            return pd.DataFrame({"x": list(x), "radius": r, "joined": joined})

        groups = -(-count // limit) // 2 + 1
        parts = written(parts.withColumn("g", F.pmod(F.xxhash64("x"), F.lit(groups))).groupBy("g").applyInPandas(join, schema))
    rows = parts.orderBy("x").collect()
    if not rows:
        raise ValueError("no rows to cluster")
    x = np.array([r["x"] for r in rows])
    distinct, first = np.unique(x, axis=0, return_inverse=True)
    radii = np.zeros(len(distinct))
    np.maximum.at(radii, first.ravel(), np.array([r["radius"] for r in rows]))
    leaders, radii, _ = _fitted(distinct, radii, max(r["joined"] for r in rows), most)
    return leaders, float(radii.max())


def ward_clusters(scaled: DataFrame, k: int = 4, micro: int = MICRO_CLUSTERS,
                  out: str = "Hierarchical_Cluster") -> tuple[DataFrame, WardTree]:
    """Ward clusters of all rows by way of at most ``micro`` weighted micro-clusters.

    With no more distinct rows than ``micro`` each is its own micro-cluster and the tree is exact. Beyond, rows join the nearest of
    at most ``micro`` leaders; sizes, centres and heights are exact for the groups that the tree forms, and only which
    micro-clusters meet first can differ, by what lies inside them (``WardTree.inside``, ``WardTree.radius``). Rows meet only their
    micro-cluster's number; the driver sees ``micro`` centres.
    """
    with temporary(scaled.sparkSession):
        points = _points(scaled)
        leaders, radius = micro_leaders(points, micro)
        sums, sizes, _ = _assign_all(points, {0: leaders})[0]
        total = float(points.agg(F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("s")).first()["s"])
    used = np.flatnonzero(sizes > 0)
    centres = sums[used] / sizes[used][:, None]
    order = np.lexsort(centres.T[::-1])
    centres, sizes, leaders = centres[order], sizes[used][order], leaders[used][order]
    inside = max(0.0, total - float((sizes[:, None] * centres * centres).sum()))
    tree = ward_merges(centres, sizes)
    tree = WardTree(centres, sizes, tree.merges, inside, radius)
    cluster_of = F.array(*[F.lit(c) for c in tree.cut(k)])
    return scaled.withColumn(out, F.get(cluster_of, nearest_centre(leaders)(F.col(SCALED)))), tree


# --------------------------------------------------------------------------- profiles


def cluster_sizes(df: DataFrame, cluster: str = "KMeans_Cluster") -> DataFrame:
    return group_shares(df, cluster)


def cluster_crosstab(df: DataFrame, k: int, rows: str = "KMeans_Cluster", columns: str = "Hierarchical_Cluster") -> DataFrame:
    return crosstab(df, rows, columns, list(range(1, k + 1)))


def cluster_profile(df: DataFrame, cluster: str = "KMeans_Cluster") -> DataFrame:
    """Twenty-one measures per cluster, highest average value first."""
    # The measures of the profile and the columns behind them.
    means = {
        "Avg_Recency": "Recency", "Avg_Frequency": "Frequency", "Avg_Monetary": "Monetary",
        "Avg_Category_Diversity": "CategoryDiversity", "Avg_Product_Diversity": "ProductDiversity",
        "Focus_Buyer_Rate": "FocusBuyer", "Avg_Focus_Spend": "FocusSpend", "Avg_RFM_Total": "RFM_total_ind",
        "Avg_Basket_Value": "AvgBasketValue", "Avg_Focus_Share": "FocusShare",
    }
    medians = {
        "Median_Recency": "Recency", "Median_Frequency": "Frequency", "Median_Monetary": "Monetary",
        "Median_Focus_Spend": "FocusSpend", "Median_Age": "Age", "Median_Income": "Income",
        "Median_Household_Size": "HouseholdSize",
    }
    groups = summarise(
        df,
        [F.count(F.lit(1)).alias("Customers"), F.sum("Monetary").alias("Total_Monetary"),
         F.sum("FocusBuyer").alias("Focus_Buyers"), *[mean_of(F.col(c)).alias(k) for k, c in means.items()]],
        medians, by=[cluster],
    )
    return groups.select(
        cluster, "Customers", ratio(F.col("Customers"), total_of("Customers")).alias("Customer_Share"),
        "Avg_Recency", "Median_Recency", "Avg_Frequency", "Median_Frequency", "Avg_Monetary", "Median_Monetary",
        "Total_Monetary", "Avg_Basket_Value", "Avg_Category_Diversity", "Avg_Product_Diversity", "Focus_Buyers",
        "Focus_Buyer_Rate", "Avg_Focus_Spend", "Median_Focus_Spend", "Avg_Focus_Share", "Median_Age", "Median_Income",
        "Median_Household_Size", "Avg_RFM_Total",
    ).orderBy(F.desc("Avg_Monetary"), cluster)


def cluster_segment_mix(df: DataFrame, cluster: str = "KMeans_Cluster", segment: str = "RFM_segment_ind") -> DataFrame:
    """Customers per cluster and segment with the share inside the cluster (windows over k x segment rows)."""
    counts = df.groupBy(cluster, segment).agg(F.count(F.lit(1)).alias("Customers"))
    share = ratio(F.col("Customers"), F.sum("Customers").over(W.partitionBy(cluster)))
    return counts.withColumn("Cluster_Share", share).orderBy(cluster, F.desc("Customers"), segment)


def cluster_segment_mix_wide(mix: DataFrame, levels: Sequence[str], cluster: str = "KMeans_Cluster",
                             segment: str = "RFM_segment_ind") -> DataFrame:
    """One column per segment, zero where a cluster has none."""
    return mix.groupBy(cluster).pivot(segment, list(levels)).agg(F.sum("Customers")).fillna(0, list(levels))


# The measures of the heatmap, in order.
HEATMAP_MEASURES = {
    "Recency": "Recency", "Frequency": "Frequency", "Monetary": "Monetary", "AvgBasketValue": "AvgBasketValue",
    "CategoryDiversity": "CategoryDiversity", "ProductDiversity": "ProductDiversity", "FocusBuyerRate": "FocusBuyer",
    "FocusSpend": "FocusSpend", "FocusShare": "FocusShare", "Income": "Income", "Age": "Age",
}


def cluster_heatmap(df: DataFrame, cluster: str = "KMeans_Cluster",
                    measures: Mapping[str, str] = HEATMAP_MEASURES) -> DataFrame:
    """Cluster means, standardised across clusters, in long form."""
    means = df.groupBy(cluster).agg(*[mean_of(F.col(c)).alias(k) for k, c in measures.items()])
    long = means.unpivot([cluster], list(measures), "Metric", "__mean")
    across = W.partitionBy("Metric")
    z = ratio(F.col("__mean") - F.avg("__mean").over(across), F.stddev_samp("__mean").over(across))
    return long.select(cluster, "Metric", z.alias("Standardised_Value"))


# --------------------------------------------------------------------------- labels


def label_roles(profile: DataFrame, overall_buyer_rate: Column, cluster: str = "KMeans_Cluster") -> DataFrame:
    """Role of each cluster from its profile.

    Clusters that buy the focus category more than average: highest mean value is loyal, the
    rest committed. Of the others, the longest away are inactive, the rest general.
    """
    focused = F.col("Focus_Buyer_Rate") > overall_buyer_rate
    side = W.partitionBy("__focused").orderBy(
        F.when(F.col("__focused"), F.col("Avg_Monetary")).otherwise(F.col("Avg_Recency")).desc(), F.col(cluster))
    first = F.row_number().over(side) == 1
    role = (
        F.when(F.col("__focused") & first, "loyal").when(F.col("__focused"), "committed")
        .when(first, "inactive").otherwise("general")
    )
    return profile.withColumn("__focused", focused).withColumn("Role", role).drop("__focused")


def label_clusters(df: DataFrame, cluster: str = "KMeans_Cluster", labels: Mapping[str, str] | None = None) -> DataFrame:
    """cluster, Role, Cluster_Label: k rows."""
    names = labels or presets.cluster_labels()
    means = df.groupBy(cluster).agg(
        mean_of(F.col("FocusBuyer")).alias("Focus_Buyer_Rate"), mean_of(F.col("Monetary")).alias("Avg_Monetary"),
        mean_of(F.col("Recency")).alias("Avg_Recency"))
    overall = df.agg(mean_of(F.col("FocusBuyer")).alias("__overall"))
    roles = label_roles(means.crossJoin(F.broadcast(overall)), F.col("__overall"), cluster)
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return roles.select(cluster, "Role", label[F.col("Role")].alias("Cluster_Label"))


def with_labels(df: DataFrame, labels: DataFrame, cluster: str = "KMeans_Cluster") -> DataFrame:
    """Left join of the k-row label table."""
    return join_on_keys(df, labels.select(cluster, "Cluster_Label"), [cluster], "left", small_right=True)


def profile_labelled(profile: DataFrame, labels: DataFrame, cluster: str = "KMeans_Cluster") -> DataFrame:
    rest = [c for c in profile.columns if c != cluster]
    return with_labels(profile, labels, cluster).select(cluster, "Cluster_Label", *rest)


def keep(df: DataFrame) -> DataFrame:
    """Vectors that an iterative fit reads many times, written once."""
    return written(df)
