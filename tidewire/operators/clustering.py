"""Clustering of scaled feature rows (id, seq and the feature columns).

Centroids are small and live on the driver as literals; rows stay distributed, and each iteration is one aggregate.
Agglomeration takes a bounded number of rows (a parameter) and refuses more, or merges a bounded number of centres of
all rows; other algorithms that need all pairs deal the rows as blocks and add up what the pairs of blocks give.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.features import NAMES
from tidewire.operators.graph import components
from tidewire.operators.neighbours import boxes as near_boxes
from tidewire.operators.neighbours import nearest_neighbours, place, within
from tidewire.operators.reach import UNITS_A_PART, Reach, crowded, labelled
from tidewire.operators.statistics import value_at_rank
from tidewire.operators.stored import stored

#: Rows of a block where all pairs of rows are met, and how many such a block of `against_all` has.
BLOCK, WIDE = 4096, 4


@dataclass
class Clustering:
    """assignments: id, cluster_id (-1 for noise); centroids by id."""

    assignments: DataFrame
    centroids: list[list[float]] = field(default_factory=list)
    iterations: int = 0
    converged: bool = True
    inertia: float | None = None
    scores: DataFrame | None = None


def distances_to(columns: list[str], centroids: list[list[float]]) -> Column:
    """Array of the Euclidean distances to each centroid, unrolled arithmetic."""
    return F.array(*[F.sqrt(sum(((F.col(c) - x) * (F.col(c) - x) for c, x in zip(columns, centre, strict=True)), F.lit(0.0))) for centre in centroids])


def nearest(scaled: DataFrame, centroids: list[list[float]], columns: list[str] = NAMES) -> DataFrame:
    """Adds cluster_id and distance; of equally near ones the lowest id."""
    out = scaled.withColumn("_d", distances_to(columns, centroids)).withColumn("distance", F.array_min("_d"))
    return out.withColumn("cluster_id", (F.array_position("_d", F.col("distance")) - 1).cast("int")).drop("_d")


def first_rows(scaled: DataFrame, k: int, columns: list[str] = NAMES) -> list[list[float]]:
    return [list(r) for r in scaled.orderBy("seq").limit(k).select(*columns).collect()]


def seeded_rows(scaled: DataFrame, k: int, seed: int, columns: list[str] = NAMES) -> list[list[float]]:
    return [list(r) for r in scaled.orderBy(F.xxhash64("seq", F.lit(seed)), "seq").limit(k).select(*columns).collect()]


def gathered(data: DataFrame, columns: list[str], size: int, function: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of function(rows, their columns): each task adds up its own blocks first."""

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for part in parts:
            for i in range(0, len(part), 4096):
                block = part.iloc[i : i + 4096]
                total += function(block, block[columns].to_numpy(float))
        yield pd.DataFrame({"i": np.arange(size), "v": total})

    out = np.zeros(size)
    for r in data.mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out


def plus_plus(scaled: DataFrame, k: int, seed: int = 0, columns: list[str] = NAMES) -> list[list[float]]:
    """k-means++: each next centre is drawn with chance in proportion to the squared distance to the nearest one. The
    draw is the largest of log(u) / d**2, so that each task sends its best row instead of a running sum over all rows."""
    centres = seeded_rows(scaled, 1, seed, columns)
    schema = "key double, seq long, " + ", ".join(f"{c} double" for c in columns)
    while centres and len(centres) < k:
        u = (F.pmod(F.xxhash64("seq", F.lit(seed), F.lit(len(centres))), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        now = np.array(centres)

        def best(parts: Iterator[pd.DataFrame], now: np.ndarray = now) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    x = part[columns].to_numpy(float)
                    near = now[nearest_centres(x, now)]
                    far = np.sqrt(((x - near) ** 2).sum(1)) ** 2
                    key = np.where(far > 0, np.log(part["u"].to_numpy()) / np.where(far > 0, far, 1), -1e300)
                    one = part.iloc[[int(np.lexsort((part["seq"], -key))[0])]]
                    yield one.assign(key=key.max())[["key", "seq", *columns]]

        row = scaled.select("seq", *columns, u.alias("u")).mapInPandas(best, schema).orderBy(F.desc("key"), "seq").first()
        centres.append([row[c] for c in columns])
    return centres


def k_means(scaled: DataFrame, k: int = 3, init: list[list[float]] | None = None, max_iterations: int = 100, tolerance: float = 1e-4, seed: int = 0, plus: bool = True, columns: list[str] = NAMES, fixed: bool = False) -> Clustering:
    """Lloyd's iterations; a cluster without members gets the zero vector. Stops where the inertia changes by no more than
    the tolerance and the centres stay; fixed: after exactly max_iterations."""
    scaled = scaled.select("id", "seq", *columns).persist()
    centres = init or (plus_plus if plus else seeded_rows)(scaled, k, seed=seed, columns=columns)
    if not centres:
        return Clustering(scaled.select("id", F.lit(0).alias("cluster_id")))
    centres, inertia, step, done = _lloyd(scaled, [centres], max_iterations, tolerance, columns, fixed)[0]
    return Clustering(nearest(scaled, centres, columns).select("id", "cluster_id"), centres, step, done, inertia)


def _lloyd(scaled: DataFrame, starts: list[list[list[float]]], max_iterations: int, tolerance: float, columns: list[str], fixed: bool = False) -> list[tuple[list[list[float]], float | None, int, bool]]:
    """(centres, inertia, iterations, converged) from each of the starts; an iteration of all is one pass over the rows."""
    found = [(centres, None, max_iterations, False) for centres in starts]
    last: list = [None] * len(starts)
    d = len(columns)
    for step in range(1, max_iterations + 1):
        running = [i for i, f in enumerate(found) if not f[3]]
        if not running:
            break
        now = [np.array(found[i][0]) for i in running]

        def sums(_, x: np.ndarray, now: list[np.ndarray] = now) -> np.ndarray:
            out = []
            for centres in now:
                member = np.zeros((len(x), len(centres)))
                if len(x):
                    member[np.arange(len(x)), nearest_centres(x, centres)] = 1.0
                out += [member.sum(0), (member.T @ x).ravel(), member.T @ (x * x).sum(1)]
            return np.concatenate(out)

        total = gathered(scaled.select(*columns), columns, sum(len(c) for c in now) * (d + 2), sums)
        for i, k in zip(running, map(len, now), strict=True):
            part, total = total[: k * (d + 2)], total[k * (d + 2) :]
            n, sum_, squares = part[:k], part[k : k + k * d].reshape(k, d), part[k + k * d :]
            means = np.where(n[:, None] > 0, sum_ / np.maximum(n, 1)[:, None], 0.0)
            inertia, centres = float((squares - n * (means**2).sum(1)).sum()), means.tolist()
            done = not fixed and last[i] is not None and abs(last[i][0] - inertia) <= tolerance and last[i][1] == centres
            found[i], last[i] = (centres, inertia, step, done), (inertia, centres)
    return found


def elbow(scaled: DataFrame, most: int = 10, iterations: int = 20, seed: int = 0, columns: list[str] = NAMES) -> tuple[int, list[float]]:
    """k from 1 whose inertia is furthest from the chord between the first and the last, and all inertias. The centres that
    fewer clusters begin with are the first of those for `most`, and all k share their passes."""
    data = scaled.select("id", "seq", *columns).persist()
    starts = plus_plus(data, most, seed, columns)
    inertias = [found[1] for found in _lloyd(data, [starts[:k] for k in range(1, most + 1)], iterations, 1e-4, columns)] if starts else [0.0] * most
    return chord(inertias) + 1, inertias


def chord(values: list[float]) -> int:
    """The first index furthest from the line through the first and the last value."""
    if len(values) < 3:
        return 0
    dx, dy = len(values) - 1, values[-1] - values[0]
    far = [abs(dy * i - dx * (v - values[0])) / math.hypot(dx, dy) for i, v in enumerate(values)]
    return far.index(max(far))


def bounded(scaled: DataFrame, most: int, columns: list[str]) -> pd.DataFrame:
    """All rows on the driver, if they are no more than `most`; in order of seq."""
    got = scaled.select("id", "seq", *columns).limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} rows; sample them first or raise the limit")
    return got.sort_values("seq", kind="stable").reset_index(drop=True)


def _pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Column by column, so that no array has more cells than pairs."""
    total = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        gap = x[:, None] - y[None, :]
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


def _by_products(x: np.ndarray, y: np.ndarray, root: bool = True) -> np.ndarray:
    """Distances, or their squares, by a matrix product; those so small that its rounding would show come from differences."""
    middle = y.mean(0) if len(y) else 0.0
    a, b = x - middle, y - middle
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d = a @ (-2.0 * b.T)
    d += aa[:, None]
    d += bb[None, :]
    i, j = np.nonzero(d <= 1e-6 * (aa.max(initial=0) + bb.max(initial=0)))
    for at in range(0, len(i), 1 << 16):
        u, v = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        d[u, v] = ((x[u] - y[v]) ** 2).sum(1)
    return np.sqrt(d, out=d) if root else d


def nearest_centres(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The first of the nearest centres of each row, by a matrix product; rows with two about as near by the distances."""
    middle = centres.mean(0)
    a, b = x - middle, centres - middle
    bb = np.einsum("ij,ij->i", b, b)
    score = bb - 2 * (a @ b.T)
    best = score.argmin(1)
    slack = 1e-12 * (np.einsum("ij,ij->i", a, a) + bb.max())
    close = np.flatnonzero((score <= (score[np.arange(len(x)), best] + slack)[:, None]).sum(1) > 1)
    for at in range(0, len(close), 512):
        some = close[at : at + 512]
        best[some] = _pairwise(x[some], centres).argmin(1)
    return best


#: Rows, other rows, distances between them, and where both are the same row.
Met = tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]


def _blocks(data: DataFrame, within: float | None, columns: list[str]) -> DataFrame:
    """Adds _own, a row's block of about WIDE * BLOCK rows, and _other, one at a time each block it has to meet: all of them, or
    with `within` those of the same and the neighbour cells of a grid of that width over three columns of greatest
    variance. A crowded cell has many blocks, so that none grows with the rows."""
    axes = []
    if within is not None:
        spread = data.agg(*[F.coalesce(F.var_pop(c), F.lit(0.0)).alias(c) for c in columns]).first()
        axes = sorted(columns, key=lambda c: -spread[c])[:3]
    cell = F.array(*[F.floor(F.col(c) / (within * (1 + 1e-9))) for c in axes]) if axes else F.array().cast("array<bigint>")
    cells = data.groupBy(cell.alias("_cell")).agg(F.ceil(F.count("*") / (WIDE * BLOCK)).alias("_n")).checkpoint()
    near = cells.withColumnRenamed("_n", "_blocks").withColumn("_near", F.col("_cell"))
    for i in range(len(axes)):
        near = near.withColumn("_step", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        moved = [F.element_at("_near", j + 1) + (F.col("_step") if i == j else F.lit(0)) for j in range(len(axes))]
        near = near.withColumn("_near", F.array(*moved)).drop("_step")
    near = near.join(cells.withColumnRenamed("_cell", "_near"), "_near").groupBy("_cell", "_blocks").agg(F.collect_list(F.struct("_near", "_n")).alias("_near"))
    every = F.flatten(F.transform("_near", lambda c: F.transform(F.sequence(F.lit(0).cast("long"), c["_n"] - 1), lambda b: F.concat(c["_near"], F.array(b)))))
    dealt = data.withColumn("_cell", cell).join(near, "_cell")
    own = F.concat("_cell", F.array(F.pmod(F.xxhash64("id"), F.col("_blocks"))))
    return dealt.withColumn("_own", own).withColumn("_other", F.explode(every)).drop("_cell", "_blocks", "_near")


def against_all(scaled: DataFrame, work: Callable[[Iterator[Met]], pd.DataFrame], schema: str, columns: list[str], *keep: str, within: float | None = None, both: bool = True, asks: str | None = None) -> DataFrame:
    """What work makes of each part of all pairs of rows: rows are dealt to blocks, each pair of blocks is a task's group,
    and its results are parts that the caller adds up. keep: columns that the rows have besides id and columns. within:
    pairs further apart than that may be left out. both: each pair of rows comes from both sides. asks: a boolean column;
    rows where it is true meet those where it is false."""
    data = scaled.select("id", *keep, *columns)
    dealt = _blocks(data, within, columns).withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other"))
    dealt = dealt.withColumn("_left", F.col("_own") == F.col("i")).withColumn("_same", F.col("i") == F.col("j")).drop("_own", "_other")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        same = bool(part["_same"].iloc[0])
        left, right = part[part["_left"]], part if same else part[~part["_left"]]

        def met() -> Iterator[Met]:
            for rows, others in ((left, right), (right, left))[: 1 if same or not both else 2]:
                if asks:
                    rows, others = rows[rows[asks]], others[~others[asks]]
                y = others[columns].to_numpy(float)
                for at in range(0, len(rows) if len(others) else 0, 256):
                    block = rows.iloc[at : at + 256]
                    d = _by_products(block[columns].to_numpy(float), y)
                    itself = np.zeros(d.shape, bool)
                    if same and not asks:
                        itself[np.arange(len(block)), at + np.arange(len(block))] = True
                    yield block, others, d, itself

        return work(met())

    return dealt.groupBy("i", "j").applyInPandas(run, schema)


def each(function: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> Callable[[Iterator[Met]], pd.DataFrame]:
    """Work that is done for a few rows at a time."""
    names = [f.split()[0] for f in schema.split(", ")]

    def work(met: Iterator[Met]) -> pd.DataFrame:
        out = [function(*m) for m in met]
        return pd.concat(out) if out else pd.DataFrame({n: [] for n in names})

    return work


def k_distances(scaled: DataFrame, k: int = 5, columns: list[str] = NAMES) -> DataFrame:
    """(id, k_distance): distance to the k-th nearest other row, to the furthest if there are fewer; 0 without others."""
    near = nearest_neighbours(scaled, k, columns, names=False)
    return near.select("id", F.coalesce(F.element_at("distances", F.when(F.size("distances") > 0, -1)), F.lit(0.0)).alias("k_distance"))


def estimate_epsilon(scaled: DataFrame, k: int = 5, columns: list[str] = NAMES) -> float:
    """The k-distance furthest from the chord of all k-distances in ascending order."""
    from tidewire.operators.browse import numbered

    ranked = numbered(k_distances(scaled, k, columns), "k_distance", "id", name="rank").checkpoint()
    n, low, high = ranked.agg(F.count("*"), F.min("k_distance"), F.max("k_distance")).first()
    if not n:
        return 0.0
    if n < 3:
        return ranked.filter(F.col("rank") == n // 2).first().k_distance
    far = F.abs((high - low) * F.col("rank") - (n - 1) * (F.col("k_distance") - low))
    return ranked.orderBy(F.desc(far), "rank").first().k_distance


def dbscan(scaled: DataFrame, epsilon: float | None = None, min_points: int = 5, columns: list[str] = NAMES) -> Clustering:
    """A row is core if it has min_points others within epsilon; clusters are components of core rows, numbered by
    their first row; other rows near a core row join the lowest such cluster; the rest is noise (-1). seq is unique.

    Pairs are never listed: rows with enough others near are found (reach.crowded), then what core rows reach
    (reach.Reach), then the remaining rows visit the core rows near them."""
    if epsilon is None:
        epsilon = estimate_epsilon(scaled, min_points, columns)
    columns = list(columns)
    from tidewire.operators.browse import numbered

    every, late = crowded(scaled, epsilon, min_points, columns)
    most, typed = UNITS_A_PART, ", ".join(f"{c} double" for c in columns)
    dealt, _ = place(late, "seq", columns)
    schema = f"seq long, {typed}, _leaf long, _part long, label long, unit long"
    pieces = stored(dealt.groupBy("_leaf", "_part").applyInPandas(lambda part: labelled(part, columns, epsilon, max(2, most // 16))[[f.split()[0] for f in schema.split(", ")]], schema))
    found = Reach([every.filter("unit >= 0"), pieces], epsilon, columns).settled(components)
    ids = stored(numbered(found.rows.select("label").distinct(), "label", name="_c").select("label", F.col("_c").cast("int").alias("_c")))
    others = found.relabelled(pieces.select("seq", "label")).select("seq", "label")
    if found.tree is not None:

        def border(visiting: pd.DataFrame, x: np.ndarray, here: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
            c = here["label"].to_numpy()
            low = np.full(len(x), np.iinfo(np.int64).max)
            for i in range(0, len(x), 64):
                for j in range(0, len(y), BLOCK):
                    near = within(x[i : i + 64], y[j : j + BLOCK], epsilon)
                    low[i : i + 64] = np.minimum(low[i : i + 64], np.where(near, c[None, j : j + BLOCK], low.dtype.type(np.iinfo(np.int64).max)).min(1))
            some = low < np.iinfo(np.int64).max
            return pd.DataFrame({"seq": visiting["seq"].to_numpy()[some], "label": low[some]})

        asking = every.filter("unit < 0").join(late.select("seq"), "seq", "left_anti")
        near = found.visited(found.near(asking), border, "seq long, label long").groupBy("seq").agg(F.min("label").alias("label"))
        others = others.union(near.select("seq", "label"))
    others = every.filter("unit < 0").select("id", "seq").join(others, "seq", "left").select("id", "label")
    of_row = found.relabelled(every.filter("unit >= 0").select("id", "label")).select("id", "label").union(others)
    return Clustering(of_row.join(ids, "label", "left").select("id", F.coalesce("_c", F.lit(-1)).alias("cluster_id")))


def agglomerate(points: np.ndarray, k: int = 3, linkage: str = "average", weights: np.ndarray | None = None) -> tuple[np.ndarray, list[tuple[int, int, int, float, int]]]:
    """Labels and the merge table (step, left, right, distance, size); nodes n and up are merges, in order.

    Repeatedly the closest pair of clusters merges (the first in order of creation among equals). The cut splits the
    node of largest merge distance until k parts are there; labels are the places of the parts in that queue. A point
    may stand for several rows, by its weight.
    """
    n = len(points)
    weights = np.ones(n) if weights is None else weights
    base = _pairwise(points, points)
    members = {i: [i] for i in range(n)}
    d = {i: {j: base[i, j] for j in range(n) if j != i} for i in range(n)}
    centre = {i: points[i] for i in range(n)}

    def between(a: int, b: int) -> float:
        if linkage in ("ward", "centroid"):
            gap = float(np.linalg.norm(centre[a] - centre[b]))
            m, o = weights[members[a]].sum(), weights[members[b]].sum()
            return gap if linkage == "centroid" else gap * gap * m * o / (m + o)
        block = base[np.ix_(members[a], members[b])]
        if linkage == "average":
            return float(np.average(block, weights=np.outer(weights[members[a]], weights[members[b]])))
        return float({"single": np.min, "complete": np.max}[linkage](block))

    if linkage in ("ward", "centroid"):
        d = {i: {j: between(i, j) for j in range(n) if j != i} for i in range(n)}
    merges, children = [], {}
    while len(members) > 1:
        order = sorted(members)
        low, a, b = min((d[i][j], i, j) for x, i in enumerate(order) for j in order[x + 1 :])
        new = n + len(merges)
        members[new] = members.pop(a) + members.pop(b)
        centre[new] = np.average(points[members[new]], axis=0, weights=weights[members[new]])
        d.pop(a), d.pop(b)
        for other in d:
            d[other].pop(a), d[other].pop(b)
        d[new] = {}
        for other in [o for o in members if o != new]:
            d[new][other] = d[other][new] = between(other, new)
        children[new] = (a, b, low)
        merges.append((len(merges), a, b, low, int(weights[members[new]].sum())))
    queue = list(members)
    while 0 < len(queue) < k:
        queue.sort(key=lambda x: -(children[x][2] if x in children else 0.0))
        if queue[0] not in children:
            break
        a, b, _ = children[queue.pop(0)]
        queue += [a, b]

    def leaves(x: int) -> list[int]:
        stack, out = [x], []
        while stack:
            y = stack.pop()
            stack.extend(children[y][:2]) if y in children else out.append(y)
        return out

    labels = np.zeros(n, np.int32)
    for i, x in enumerate(queue):
        labels[leaves(x)] = i
    return labels, merges


def hierarchical(scaled: DataFrame, k: int = 3, linkage: str = "average", columns: list[str] = NAMES, most: int = 400) -> Clustering:
    """Cubic in the rows, so at most `most` of them, computed at one place."""
    rows = bounded(scaled, most, columns)
    labels, merges = agglomerate(rows[columns].to_numpy(float), k, linkage) if len(rows) else (np.zeros(0), [])
    spark = scaled.sparkSession
    out = spark.createDataFrame(list(zip(rows["id"].tolist(), [int(x) for x in labels])), "id string, cluster_id int")
    return Clustering(out, iterations=len(merges))


def coarse(scaled: DataFrame, most: int, columns: list[str] = NAMES, iterations: int = 10, seed: int = 0) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """All rows (id, place) with their place among at most `most` centres, the centres and how many rows each has. The
    centres are k-means' from rows drawn by hash; centres without rows are left out."""
    found = k_means(scaled, most, max_iterations=iterations, seed=seed, plus=False, columns=columns).centroids
    now = np.array(found).reshape(-1, len(columns))

    def nearest_of(x: np.ndarray) -> np.ndarray:
        return nearest_centres(x, now) if len(now) else np.zeros(len(x), int)

    used = gathered(scaled.select(*columns), columns, max(1, len(now)), lambda _, x: np.bincount(nearest_of(x), minlength=max(1, len(now))).astype(float))[: len(now)]
    now, used = now[used > 0], used[used > 0]

    def places(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "place": nearest_of(part[columns].to_numpy(float)).astype(np.int32)})

    return scaled.select("id", *columns).mapInPandas(places, "id string, place int"), now, used


def hierarchical_of_centres(scaled: DataFrame, k: int = 3, linkage: str = "average", columns: list[str] = NAMES, centres: int = 120, seed: int = 0) -> Clustering:
    """Agglomeration of any number of rows: what merges are `centres` k-means centres, weighted by their rows, at every
    size alike; a row has its centre's cluster. Only the centres are agglomerated at one place."""
    placed, points, sizes = coarse(scaled, centres, columns, seed=seed)
    labels, merges = agglomerate(points, k, linkage, sizes) if len(points) else (np.zeros(1, np.int32), [])
    of = F.array(*[F.lit(int(x)) for x in labels])
    return Clustering(placed.select("id", F.element_at(of, F.col("place") + 1).alias("cluster_id")), points.tolist(), len(merges))


def estimate_bandwidth(scaled: DataFrame, columns: list[str] = NAMES, k: int = 5) -> float | None:
    """The median distance to the k-th neighbour, between the two middle ones of an even number; None without rows."""
    far = k_distances(scaled, k, columns).checkpoint()
    n = far.count()
    middle = [value_at_rank(far, "k_distance", r) for r in ((n + 1) // 2, n // 2 + 1)] if n else [None]
    return None if middle[0] is None else sum(middle) / len(middle)


def mean_shift(scaled: DataFrame, bandwidth: float | None = 0.5, max_iterations: int = 100, tolerance: float = 1e-3, columns: list[str] = NAMES) -> Clustering:
    """Every row climbs to its mode over the density of all rows; modes are merged in order of seq with the first centre
    less than half a bandwidth away. bandwidth None: the median distance to the fifth neighbour.

    Rows of which bounds show that they end at a known mode (attraction.py) aren't climbed: the first of them by seq climbs
    for all. Other rows climb, each by sums over all rows; should a centre be so near half a bandwidth from a mode that
    its rows might not all agree, they climb too."""
    from tidewire.operators.attraction import attracted

    if bandwidth is None:
        bandwidth = estimate_bandwidth(scaled, columns) or 0.5
    columns = list(columns)
    known, rows = attracted(scaled, bandwidth, max_iterations, tolerance, columns)
    while True:
        first = {r.mode: (r.seq, r.id) for r in rows.filter("mode >= 0").groupBy("mode").agg(F.min("seq").alias("seq"), F.min_by("id", "seq").alias("id")).collect()}
        climbs = (F.col("mode") < 0) | F.col("seq").isin([seq for seq, _ in first.values()])
        climbed = _climbed(rows.filter(climbs), rows.select(*columns), bandwidth, max_iterations, tolerance, columns)
        assigned, centres = _merged(climbed.select("id", "seq", F.transform("at", lambda x: F.round(x, 6)).alias("mode")).checkpoint(), bandwidth)
        unsure = []
        for m in first:
            far = _pairwise(known[m].at[None], np.array(centres))[0]
            within = np.flatnonzero(far < bandwidth / 2 - known[m].error - 1e-5)
            # centres before the first one that all its rows are near must be too far for all
            if not len(within) or (far[: within[0]] <= bandwidth / 2 + known[m].error + 1e-5).any():
                unsure.append(m)
        if not unsure:
            cluster = {r.id: r.cluster_id for r in assigned.filter(F.col("id").isin([id for _, id in first.values()])).collect()}
            of = F.get(F.array(*[F.lit(cluster[first[m][1]] if m in first else -1) for m in range(len(known))]), F.col("mode")) if known else F.lit(-1)
            return Clustering(assigned.union(rows.filter(~climbs).select("id", of.cast("int").alias("cluster_id"))), centres)
        rows = rows.withColumn("mode", F.when(F.col("mode").isin(unsure), -1).otherwise(F.col("mode")))


def _climbed(climbing: DataFrame, every: DataFrame, bandwidth: float, max_iterations: int, tolerance: float, columns: list[str]) -> DataFrame:
    """(id, seq, at): where rows end. A few climb by a pass over all rows for each iteration; else each iteration deals the
    places of the rows that still move and all rows as blocks, and adds up the sums."""
    from tidewire.operators.attraction import FEW, stepped

    few = climbing.limit(FEW + 1).select("id", "seq", *columns).toPandas()
    if len(few) <= FEW:
        at, moves = few[columns].to_numpy(float), np.ones(len(few), bool)
        for _ in range(max_iterations):
            if not moves.any():
                break
            was = at[moves]
            at[moves] = stepped(every, was, bandwidth, columns)
            moves[moves] = ~(np.sqrt(((at[moves] - was) ** 2).sum(1)) < tolerance)
        ended = list(zip(few["id"].tolist(), few["seq"].tolist(), at.tolist(), strict=True))
        return every.sparkSession.createDataFrame(ended, "id string, seq long, at array<double>")
    width = len(columns) + 1
    fixed = every.select(F.array(*columns).alias("at")).checkpoint()
    n = max(1, -(-fixed.count() // BLOCK))
    fixed = fixed.withColumn("b", F.pmod(F.xxhash64("at", F.monotonically_increasing_id()), F.lit(n)).cast("int")).checkpoint()

    def pulled(key: tuple, rows: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.array(p["at"].tolist()).reshape(len(p), len(columns)) for p in (rows, others))
        sums = np.zeros((len(x), width))
        for i in range(0, len(x), 256):
            w = np.exp(_by_products(x[i : i + 256], y, False) / (-2 * bandwidth * bandwidth))
            sums[i : i + 256] = np.column_stack((w @ y, w.sum(1)))
        return pd.DataFrame({"at": rows["at"].to_numpy(), "sums": list(sums)})

    # rows at one place climb together; place is where they began
    start = climbing.select("id", "seq", F.array(*columns).alias("place"))
    moving, ended = start.select("place").distinct().withColumn("at", F.col("place")).checkpoint(), []
    for _ in range(max_iterations):
        if not (left := moving.count()):
            break
        groups = max(1, -(-left // BLOCK))
        dealt = moving.select("at").distinct().withColumn("a", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        met = fixed.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        parts = dealt.groupBy("a", "b").cogroup(met.groupBy("a", "b")).applyInPandas(pulled, "at array<double>, sums array<double>")
        sums = parts.groupBy("at").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)])
        to = sums.select("at", F.array(*[F.col(f"s{i}") / F.col(f"s{width - 1}") for i in range(width - 1)]).alias("to"))
        step = F.sqrt(F.aggregate(F.zip_with("to", "at", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda p, q: p + q))
        now = moving.join(to, "at").select("place", F.col("to").alias("at"), (step < tolerance).alias("done")).checkpoint()
        ended.append(now.filter("done").drop("done"))
        moving = now.filter("not done").drop("done")
    for part in ended:
        moving = moving.union(part)
    return start.join(moving, "place").select("id", "seq", "at")


def _merged(modes: DataFrame, bandwidth: float) -> tuple[DataFrame, list[list[float]]]:
    """(id, cluster_id) and the centres: the next modes in order that no centre is near, until none is left."""
    centres: list[list[float]] = []

    def named(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 1024):
                block = part.iloc[i : i + 1024]
                near = _distances(np.array(block["mode"].tolist()), np.array(centres)) < bandwidth / 2 if centres else np.zeros((len(block), 1), bool)
                # the first centre near enough, not the nearest
                yield block.assign(cluster_id=np.where(near.any(1), near.argmax(1), -1).astype(np.int32))

    schema = "id string, seq long, mode array<double>, cluster_id int"
    while rest := modes.mapInPandas(named, schema).filter("cluster_id < 0").orderBy("seq").limit(1000).collect():
        known = len(centres)
        for r in rest:
            if not any(math.dist(r.mode, c) < bandwidth / 2 for c in centres[known:]):
                centres.append(r.mode)
    return modes.mapInPandas(named, schema).select("id", "cluster_id"), centres


def gaussian_mixture(scaled: DataFrame, k: int = 3, max_iterations: int = 100, tolerance: float = 1e-3, seed: int = 0, columns: list[str] = NAMES, floor: float = 1e-6) -> Clustering:
    """Diagonal EM: each iteration sums responsibilities in the tasks (one small row per task) and adds these up."""
    centres = np.array(plus_plus(scaled, k, seed, columns))
    if not len(centres):
        return Clustering(scaled.select("id", F.lit(0).alias("cluster_id")))
    k, d = centres.shape
    variances, weights, last = np.ones((k, d)), np.full(k, 1 / k), None
    data = scaled.select("id", *columns).persist()

    def densities(x: np.ndarray) -> np.ndarray:
        return np.log(weights) - 0.5 * (np.log(2 * np.pi * variances).sum(1) + np.stack([(x - c) ** 2 @ (1 / v) for c, v in zip(centres, variances, strict=True)], 1))

    for step in range(1, max_iterations + 1):  # noqa: B007

        def sums(_, y: np.ndarray) -> np.ndarray:
            if not len(y):
                return np.zeros(k * (1 + 2 * d) + 1)
            log = densities(y)
            top = log.max(1, keepdims=True)
            each = np.exp(log - top)
            r = each / each.sum(1, keepdims=True)
            return np.concatenate((r.sum(0), (r.T @ y).ravel(), (r.T @ (y * y)).ravel(), [(top[:, 0] + np.log(each.sum(1))).sum()]))

        total = gathered(data, columns, k * (1 + 2 * d) + 1, sums)
        n = np.maximum(total[:k], 1e-12)
        centres = total[k : k + k * d].reshape(k, d) / n[:, None]
        variances = np.maximum(total[k + k * d : -1].reshape(k, d) / n[:, None] - centres**2, floor)
        weights = n / n.sum()
        if last is not None and abs(total[-1] - last) < tolerance:
            break
        last = total[-1]

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part[columns].to_numpy(float)
            yield pd.DataFrame({"id": part["id"], "cluster_id": densities(x).argmax(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)})

    return Clustering(data.mapInPandas(assign, "id string, cluster_id int"), centres.tolist(), step)


def self_organizing_map(scaled: DataFrame, side: int = 3, iterations: int = 100, seed: int = 0, columns: list[str] = NAMES) -> Clustering:
    """A batch map: each iteration finds every row's cell and moves all cells to the neighbourhood-weighted means (one
    aggregate). The sequential rule depends on row order and can't be distributed; results differ from it. Ids are
    cells x * side + y, numbered without gaps."""
    cells = [(x, y) for x in range(side) for y in range(side)]
    grid = np.random.default_rng(seed).random((len(cells), len(columns)))
    far = np.array([[math.dist(a, b) for b in cells] for a in cells])
    data = scaled.select("id", "seq", *columns).persist()
    rounds = max(1, iterations)
    for t in range(rounds):
        radius = max(side / 2 * (1 - t / rounds), 0.3)

        def sums(_, x: np.ndarray, grid: np.ndarray = grid) -> np.ndarray:
            member = np.eye(len(grid))[_pairwise(x, grid).argmin(1)] if len(x) else np.zeros((0, len(grid)))
            return np.concatenate((member.sum(0), (member.T @ x).ravel()))

        total = gathered(data.select(*columns), columns, grid.size + len(cells), sums)
        n, s = total[: len(cells)], total[len(cells) :].reshape(grid.shape)
        pull = np.exp(-(far**2) / (2 * radius * radius))
        mass = pull @ n
        grid = np.where(mass[:, None] > 1e-9, pull @ s / np.maximum(mass, 1e-9)[:, None], grid)
    found = nearest(data, grid.tolist(), columns)
    used = sorted(r.cluster_id for r in found.select("cluster_id").distinct().collect())
    dense = F.create_map(*[F.lit(x) for i, c in enumerate(used) for x in (c, i)])[F.col("cluster_id")] if used else F.lit(0)
    return Clustering(found.select("id", dense.cast("int").alias("cluster_id")), [grid[c].tolist() for c in used], rounds)


def average_path(n: Column | float):
    """Expected depth of an unsuccessful search among n rows; 0 for one row or none."""
    if isinstance(n, Column):
        return F.when(n > 1, 2 * (F.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n).otherwise(0.0)
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 1 else 0.0


def _tree(x: np.ndarray, height: int, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """Nodes (column or -1, split, left, right, depth with what a leaf's rows would add)."""
    nodes: list = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(None)
        column = int(rng.integers(x.shape[1]))
        low, high = (rows[:, column].min(), rows[:, column].max()) if len(rows) else (0, 0)
        if depth >= height or len(rows) <= 1 or low == high:
            nodes[at] = (-1, 0.0, 0, 0, depth + average_path(float(len(rows))))
            return at
        split = float(rng.uniform(low, high))
        left = grow(rows[rows[:, column] < split], depth + 1)
        right = grow(rows[rows[:, column] >= split], depth + 1)
        nodes[at] = (column, split, left, right, 0.0)
        return at

    grow(x, 0)
    return nodes


def isolation_forest(scaled: DataFrame, trees: int = 100, sample: int = 256, contamination: float = 0.1, seed: int = 0, columns: list[str] = NAMES) -> Clustering:
    """Each tree grows from a seeded sample in a task of its own; the forest (bounded by trees x sample) scores all rows.
    Rows whose score reaches that of rank floor(contamination * n) + 1 are noise (-1), the others cluster 0."""
    n = scaled.count()
    if not n:
        return Clustering(scaled.select("id", F.lit(0).alias("cluster_id")))
    size = min(sample, n)
    # trees x sample rows by hash are enough for all trees; each tree takes its own part of them by another hash
    pool = scaled.orderBy(F.xxhash64("seq", F.lit(seed)), "seq").limit(min(n, trees * sample)).select("seq", *columns)
    drawn = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    share = min(1.0, 1.3 * size / min(n, trees * sample) + 1e-3)
    drawn = drawn.filter((F.pmod(F.xxhash64("seq", "tree", F.lit(seed)), F.lit(1 << 20)) < share * (1 << 20)))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        rows = part.sort_values("seq")[columns].to_numpy(float)
        rng = np.random.default_rng([seed, tree])
        rows = rows[rng.permutation(len(rows))[:size]]
        nodes = _tree(rows, math.ceil(math.log2(max(size, 2))), rng)
        return pd.DataFrame([(tree, i, *node) for i, node in enumerate(nodes)], columns=["tree", "node", "attr", "split", "l", "r", "depth"])

    forest = drawn.groupBy("tree").applyInPandas(build, "tree int, node int, attr int, split double, l int, r int, depth double").toPandas()
    grown = [t.sort_values("node")[["attr", "split", "l", "r", "depth"]].to_numpy(float) for _, t in forest.groupby("tree")]
    norm = average_path(float(sample))

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part[columns].to_numpy(float)
            depth = np.zeros(len(x))
            for tree in grown:
                at = np.zeros(len(x), np.int64)
                while True:
                    attr = tree[at, 0].astype(np.int64)
                    inner = np.flatnonzero(attr >= 0)
                    if not len(inner):
                        break
                    left = x[inner, attr[inner]] < tree[at[inner], 1]
                    at[inner] = np.where(left, tree[at[inner], 2], tree[at[inner], 3]).astype(np.int64)
                depth += tree[at, 4]
            yield pd.DataFrame({"id": part["id"], "score": 2.0 ** (-depth / len(grown) / norm)})

    scored = scaled.select("id", *columns).mapInPandas(score, "id string, score double").checkpoint()
    cut = value_at_rank(scored, "score", n - int(contamination * n + 1e-9))
    cut = 0.5 if cut is None else cut
    flagged = scored.withColumn("cluster_id", F.when(F.col("score") >= cut, -1).otherwise(0))
    return Clustering(flagged.select("id", "cluster_id"), scores=scored, iterations=trees)


def summary(flows: DataFrame, assignments: DataFrame, ids: int | None = None) -> DataFrame:
    """Per cluster: size, density (share of all flows), means of the sizes. ids: list empty clusters 0..ids-1 too."""
    n = flows.count() or 1
    joined = flows.join(assignments, "id")
    joined = joined.drop(flows["cluster_id"]) if "cluster_id" in flows.columns else joined
    out = joined.groupBy("cluster_id").agg(F.count("*").alias("size"), F.avg("byte_count").alias("avg_bytes"), F.avg("packet_count").alias("avg_packets"), F.avg("duration").alias("avg_duration"))
    if ids is not None:
        out = flows.sparkSession.range(ids).select(F.col("id").cast("int").alias("cluster_id")).join(out, "cluster_id", "left").fillna(0)
    return out.withColumn("density", F.col("size") / n)


def cluster_protocols(flows: DataFrame, assignments: DataFrame) -> DataFrame:
    return flows.join(assignments, "id").groupBy("cluster_id", "protocol").agg(F.count("*").alias("flow_count"))


def top_protocols(flows: DataFrame, assignments: DataFrame, n: int = 5) -> DataFrame:
    """Each cluster's n most frequent protocols, by rank from 1."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("flow_count"), "protocol"))
    return cluster_protocols(flows, assignments).withColumn("rank", rank).filter(F.col("rank") <= n)


def first_members(flows: DataFrame, assignments: DataFrame, n: int = 5) -> DataFrame:
    """Each cluster's first n flows; tasks cut their part to n rows before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy("seq"))
    joined = flows.select("id", "seq", "source_ip", "destination_ip").join(assignments, "id")
    return joined.withColumn("rank", rank).filter(F.col("rank") <= n)


def boxes(points: DataFrame, axes: list[str], least: int = 4) -> DataFrame:
    """Bounding box and mean point of each cluster of at least four points."""
    sides = [f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return points.groupBy("cluster_id").agg(F.count("*").alias("size"), *sides).filter(F.col("size") >= least)


def bounds(scaled: DataFrame, assignments: DataFrame, columns: list[str] = NAMES) -> DataFrame:
    return scaled.join(assignments, "id").groupBy("cluster_id").agg(*[F.min(c).alias(f"min_{c}") for c in columns], *[F.max(c).alias(f"max_{c}") for c in columns])


def silhouette(scaled: DataFrame, assignments: DataFrame, columns: list[str] = NAMES) -> DataFrame:
    """(id, cluster_id, score) of rows that are no noise: (b - a) / max(a, b) of the mean distances to the own and to the
    nearest other cluster; 0 for b without another cluster. Over all pairs of rows.

    Rows are dealt to blocks: a large cluster has blocks of its own, small ones share blocks but are never parted. Each two
    blocks are a task's group. Between blocks of large clusters a distance is taken once and added up for both its rows; of
    small clusters, which are whole there, only the means that count are kept. So groups are bounded by the block."""
    columns, most = list(columns), 8 * BLOCK
    data = scaled.select(F.col("id").cast("string").alias("id"), *[F.col(c).cast("double").alias(c) for c in columns])
    data = stored(data.join(assignments.filter("cluster_id >= 0").select(F.col("id").cast("string").alias("id"), F.col("cluster_id").cast("int").alias("_c")), "id"))
    sizes = stored(data.groupBy("_c").agg(F.count("*").alias("_n")))
    large = F.col("_n") > most // 4
    pools = -(-(sizes.filter(~large).agg(F.sum("_n")).first()[0] or 0) // (most // 2)) or 1
    blocks = F.ceil(F.col("_n") / most)
    # blocks of large clusters from 0 on, of small ones below
    own = F.when(large, F.col("_c") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), blocks)).otherwise(-1 - F.pmod(F.xxhash64("_c"), F.lit(pools)))
    chunk = 2048

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_c", kind="stable")
        x, of, ids = np.ascontiguousarray(part[columns].to_numpy(float)), part["_c"].to_numpy(np.int32), part["id"].to_numpy()
        if part["_own"].iloc[0] >= 0:
            order = np.concatenate(near_boxes(x, 256))
            x, of, ids = x[order], of[order], ids[order]
        starts = range(0, len(x), chunk)
        cells = {"x": [x[i : i + chunk].tobytes() for i in starts], "c": [of[i : i + chunk].tobytes() for i in starts]}
        return pd.DataFrame({"_own": part["_own"].iloc[0], "_chunk": np.arange(len(starts)), **cells, "ids": [ids[i : i + chunk].tolist() for i in starts], "n": part["_n"].iloc[0]})

    schema = "_own long, _chunk int, x binary, c binary, ids array<string>, n long"
    rows = stored(data.join(sizes, "_c").withColumn("_own", own).groupBy("_own").applyInPandas(packed, schema))
    named = stored(rows.select("_own").distinct())
    pairs = named.select(F.col("_own").alias("i")).crossJoin(named.select(F.col("_own").alias("j"))).filter("i <= j")
    n = named.count()
    tasks = min(1 << 14, 2 * n * (n + 1))
    sides = [rows.select("_own", "_chunk", "x", "c").join(pairs.withColumn("_own", F.col(s)), "_own").filter(F.lit(s == "i") | (F.col("i") < F.col("j"))) for s in "ij"]

    def met(key: tuple[int, int], part: pd.DataFrame) -> pd.DataFrame:
        (i, j), out = key, []
        x, y = (_unpacked(part[part["_own"] == b].sort_values("_chunk"), len(columns)) for b in (i, j))
        if i >= 0:  # j too: distances between rows of two clusters, or of one
            total = _sums(x[0], y[0], i == j)
            halves = [(i, j, total[0])] if i == j else [(i, j, total[0]), (j, i, total[1])]
            for own, other, far in halves:
                out += [(own, at // chunk, other >> 32, far[at : at + chunk].tobytes(), None) for at in range(0, len(far), chunk)]
        else:
            for own, other, rows, others in ((i, j, x, y), (j, i, y, x))[: 1 if i == j else 2]:
                for at in range(0, len(rows[0]), chunk):
                    some = slice(at, at + chunk)
                    if other >= 0:
                        out.append((own, at // chunk, other >> 32, _sums(rows[0][some], others[0], False)[0].tobytes(), None))
                    else:
                        within, nearest = _of_small(rows[0][some], rows[1][some], *others)
                        out.append((own, at // chunk, -1, within.tobytes() if own == other else None, nearest.tobytes()))
        return pd.DataFrame(out, columns=["_own", "_chunk", "other", "far", "near"])

    parts = sides[0].union(sides[1]).repartition(tasks, "i", "j").groupBy("i", "j").applyInPandas(met, "_own long, _chunk int, other int, far binary, near binary")
    parts = parts.join(sizes.select(F.col("_c").alias("other"), F.col("_n").alias("count")), "other", "left")

    def scored(here: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        ids, of = here["ids"].iloc[0], np.frombuffer(here["c"].iloc[0], np.int32)
        a, b = np.zeros(len(ids)), np.full(len(ids), np.inf)
        for (other, count), same in found.fillna({"count": 0}).groupby(["other", "count"]):
            far = [np.frombuffer(f) for f in same["far"] if f is not None]
            if other < 0:
                a = far[0] if far else a
                b = np.minimum(b, np.min([np.frombuffer(f) for f in same["near"]], axis=0))
            elif other == of[0] and here["_own"].iloc[0] >= 0:
                a = np.sum(far, axis=0) / max(count - 1, 1)
            else:
                b = np.minimum(b, np.sum(far, axis=0) / count)
        b[np.isinf(b)] = 0.0
        top = np.maximum(a, b)
        return pd.DataFrame({"id": ids, "cluster_id": of, "score": np.where(top > 0, (b - a) / np.where(top > 0, top, 1), 0.0)})

    keys = ("_own", "_chunk")
    return rows.select("_own", "_chunk", "c", "ids").groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInPandas(scored, "id string, cluster_id int, score double")


def _unpacked(cells: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(cells["x"])).reshape(-1, d), np.frombuffer(b"".join(cells["c"]), np.int32)


def _sums(x: np.ndarray, y: np.ndarray, same: bool, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sum of distances to all of the others, for both sides. Squares come from one matrix product a tile; where
    its rounding could show, from differences. same: x and y are the same rows."""
    n, m, d = len(x), len(y), x.shape[1]
    left, right, one = np.zeros(n), np.zeros(m), np.ones(tile)
    middle = (x[0] + y[0]) / 2
    a, b = x - middle, y - middle
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    sure = 1e-6 * (aa.max() + bb.max())
    b = np.ascontiguousarray(-2.0 * b.T)
    at = [range(0, k, tile) for k in (n, m)]
    box = [np.array([(s[i : i + tile].min(0), s[i : i + tile].max(0)) for i in r]).reshape(-1, 2, d) for s, r in zip((x, y), at, strict=True)]
    room, others = np.empty(tile * tile), np.empty((d + 2, m))
    for u, i in enumerate(at[0]):
        # columns in which the tile has one value give each of the others a number
        rows = a[i : i + tile]
        used = np.flatnonzero(rows.min(0) < rows.max(0))
        flat, k = rows[0].copy(), len(used)
        flat[used] = 0.0
        np.take(b, used, axis=0, out=others[:k], mode="clip")
        others[k], others[k + 1] = 1.0, bb + flat @ b + (flat * flat).sum()
        rows = np.column_stack((rows[:, used], np.einsum("ij,ij->i", rows[:, used], rows[:, used]), np.ones(len(rows))))
        gap = np.maximum(np.maximum(box[1][:, 0] - box[0][u, 1], box[0][u, 0] - box[1][:, 1]), 0.0)
        clear = (gap * gap).sum(1) > 2 * sure
        for v, j in enumerate(at[1]):
            if same and v < u:
                continue
            far = room[: len(rows) * min(tile, m - j)].reshape(len(rows), -1)
            np.dot(rows, others[: k + 2, j : j + tile], out=far)
            if not clear[v] and far.min() <= sure:
                s, t = np.nonzero(far <= sure)
                if 16 * len(s) > far.size:
                    far[:] = _by_products(x[i : i + tile], y[j : j + tile], root=False)
                else:
                    far[s, t] = ((x[i + s] - y[j + t]) ** 2).sum(1)
            np.sqrt(far, out=far)
            left[i : i + tile] += far @ one[: far.shape[1]]
            if not same or v > u:
                right[j : j + tile] += one[: len(rows)] @ far
    return (left + right, right) if same else (left, right)


def _of_small(x: np.ndarray, own: np.ndarray, y: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's mean distance to the others of its cluster, and the least to another cluster; y are whole clusters, in
    their order."""
    names, starts, count = np.unique(of, return_index=True, return_counts=True)
    within, nearest = np.zeros(len(x)), np.full(len(x), np.inf)
    for i in range(0, len(x), 128):
        some, c = x[i : i + 128], own[i : i + 128]
        total = np.add.reduceat(_by_products(some, y), starts, axis=1)
        at = np.minimum(np.searchsorted(names, c), len(names) - 1)
        mine = np.flatnonzero(names[at] == c)
        within[i + mine] = total[mine, at[mine]] / np.maximum(count[at[mine]] - 1, 1)
        total /= count
        total[mine, at[mine]] = np.inf
        nearest[i : i + 128] = total.min(1)
    return within, nearest


def sampled_silhouette(scaled: DataFrame, assignments: DataFrame, columns: list[str] = NAMES, most: int = 200) -> DataFrame:
    """As silhouette, of a systematic sample of at most about `most` rows, each against all rows: one pass, in which every
    task adds up its rows' distances to the sample by cluster."""
    from tidewire.operators.browse import systematic_sample

    data = scaled.select("id", "seq", *columns).join(assignments.filter("cluster_id >= 0").select("id", F.col("cluster_id").cast("int").alias("_c")), "id").checkpoint()
    sample = systematic_sample(data, most).orderBy("seq").select("id", "_c", *columns).toPandas()  # a bounded number
    points, ids = sample[columns].to_numpy(float), sample["id"].to_numpy()
    place = {x: i for i, x in enumerate(ids)}

    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in parts:
            for i in range(0, len(part), 4096):
                block = part.iloc[i : i + 4096]
                d, of = _by_products(block[columns].to_numpy(float), points), block["_c"].to_numpy()
                other = np.ones(d.shape)
                for row in np.flatnonzero(block["id"].isin(place)).tolist():
                    name = block["id"].iloc[row]
                    d[row, place[name]] = other[row, place[name]] = 0.0
                for c in np.unique(of).tolist():
                    total[c] = total.get(c, 0) + np.stack((d[of == c].sum(0), other[of == c].sum(0)))
        for c, (far, n) in total.items():
            yield pd.DataFrame({"place": np.arange(len(points), dtype=np.int32), "other": np.int32(c), "total": far, "n": n})

    schema = "place int, other int, total double, n double"
    means = data.select("id", "_c", *columns).mapInPandas(sums, schema).groupBy("place", "other").agg((F.sum("total") / F.when(F.sum("n") > 0, F.sum("n"))).alias("mean"))
    own = scaled.sparkSession.createDataFrame([(i, x, int(c)) for i, (x, c) in enumerate(zip(ids, sample["_c"], strict=True))], "place int, id string, cluster_id int")
    same = F.col("other") == F.col("cluster_id")
    of_row = means.join(own, "place").groupBy("id", "cluster_id")
    ab = of_row.agg(F.coalesce(F.max(F.when(same, F.col("mean"))), F.lit(0.0)).alias("a"), F.coalesce(F.min(F.when(~same, F.col("mean"))), F.lit(0.0)).alias("b"))
    top = F.greatest("a", "b")
    return ab.select("id", "cluster_id", F.when(top > 0, (F.col("b") - F.col("a")) / top).otherwise(0.0).alias("score"))


ALGORITHMS: dict[str, Callable[..., Clustering]] = {
    "kmeans": lambda df, **p: k_means(df, plus=False, **p),
    "kmeans++": k_means,
    "dbscan": dbscan,
    "hierarchical": hierarchical,
    "meanshift": mean_shift,
    "gaussianmixturemodel": gaussian_mixture,
    "gmm": gaussian_mixture,
    "selforganizingmap": self_organizing_map,
    "som": self_organizing_map,
    "isolationforest": isolation_forest,
}


def algorithm(name: str) -> Callable[..., Clustering]:
    """By name, whatever its case, spaces and hyphens."""
    key = name.strip().lower().replace(" ", "").replace("-", "").replace("_", "")
    if key not in ALGORITHMS:
        raise ValueError(f"no algorithm {name!r}; known: {', '.join(ALGORITHMS)}")
    return ALGORITHMS[key]
