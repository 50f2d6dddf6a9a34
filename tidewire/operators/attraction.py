"""Which mode rows climb to by mean shift, by bounds on its step instead of by climbing.

A step takes a point x to T(x), the mean of all rows y with weights exp(-|x - y|^2 / 2h^2). Its derivative is the weighted
covariance of the rows over h^2. With w the weights at a point c, W their sum and v = y - T(c), the weights at c + u are
proportional to w exp(u.v / h^2), and their sum is at least W (Jensen, since w has the mean T(c)). So

    |T(x) - T(c)| <= B(|x - c|),  B(s) = greatest eigenvalue of the sum of (w / W) (exp(s|v| / h^2) - 1) / |v| v v'

which is one pass over the rows for any bounded number of points c; B is convex and B(0) = 0. Around a mode m, the rows
within a reach S with B(S) < S never leave it and come ever closer. Other rows are within a radius r of one of a bounded
number of points c with |T(c) - m| + B(r) < S: their first step takes them into the reach. Every row is judged by
these bounds, which hold for all rows; rows that they don't cover are left for climbing. Which points are tried affects
the time, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.features import NAMES
from tidewire.operators.clustering import _by_products, gathered
from tidewire.operators.stored import stored

#: Rows that climb to find modes, points that are tried in a round, rows of the sample they come from, rounds.
STARTS, POINTS, SAMPLE, ROUNDS = 32, 128, 8192, 4
#: As few rows as this climb by passes over all rows instead.
FEW = 1024
#: Radii that are tried: around modes, in bandwidths, and around points, in parts of the mode's reach.
RADII, PARTS = np.geomspace(0.01, 8.0, 64), np.array([0.45, 0.65, 0.8, 0.9])


@dataclass
class Mode:
    """Rows within reach of at, and those that a step takes there, end within error of it."""

    at: np.ndarray
    reach: float
    error: float


def stepped(data: DataFrame, points: np.ndarray, bandwidth: float, columns: list[str]) -> np.ndarray:
    """T of a few points: one pass over all rows. Not a number where all weights vanish."""

    def sums(_, y: np.ndarray) -> np.ndarray:
        w = np.exp(-_by_products(points, y, False) / (2 * bandwidth * bandwidth)) if len(y) else np.zeros((len(points), 0))
        return np.column_stack((w @ y, w.sum(1))).ravel()

    total = gathered(data.select(*columns), columns, len(points) * (len(columns) + 1), sums).reshape(len(points), -1)
    with np.errstate(all="ignore"):
        return total[:, :-1] / total[:, -1:]


def spreads(data: DataFrame, points: np.ndarray, to: np.ndarray, radii: np.ndarray, bandwidth: float, columns: list[str]) -> np.ndarray:
    """B of each point at each of its radii (points x radii), `to` being T of the points; infinite where it isn't finite."""
    n, d, many = len(points), len(columns), radii.shape[1]
    i, j = np.triu_indices(d)
    middle = to.mean(0)
    width = 2 + d + len(i)

    def sums(_, y: np.ndarray) -> np.ndarray:
        out = np.zeros((many, n, width))
        for at in range(0, len(y), 1024):
            part = y[at : at + 1024]
            z = part - middle
            moments = np.column_stack((np.ones(len(z)), z, z[:, i] * z[:, j]))
            log = -_by_products(points, part, False) / (2 * bandwidth * bandwidth)
            far, w = _by_products(to, part), np.exp(log)
            near = far < 1e-9
            for k in range(many):
                s = radii[:, k : k + 1] / bandwidth**2
                with np.errstate(all="ignore"):
                    g = np.where(near, w * s, (np.exp(log + s * far) - w) / np.where(near, 1.0, far))
                    out[k, :, :-1] += g @ moments
                out[k, :, -1] += w.sum(1)
        return out.ravel()

    total = gathered(data.select(*columns), columns, many * n * width, sums).reshape(many, n, width)
    found = np.full((n, many), np.inf)
    t = to - middle
    for k in range(many):
        for p in range(n):
            zero, one, two, weight = total[k, p, 0], total[k, p, 1 : d + 1], np.zeros((d, d)), total[k, p, -1]
            two[i, j] = two[j, i] = total[k, p, d + 1 : -1]
            with np.errstate(all="ignore"):
                matrix = (two - np.outer(t[p], one) - np.outer(one, t[p]) + zero * np.outer(t[p], t[p])) / weight
            if weight > 0 and np.isfinite(matrix).all():
                found[p, k] = np.linalg.eigvalsh(matrix)[-1] * (1 + 1e-9) + 1e-12
    return found


def _modes(data: DataFrame, starts: np.ndarray, known: list[Mode], bandwidth: float, max_iterations: int, tolerance: float, columns: list[str]) -> list[Mode]:
    """The modes that some rows climb to, as far as they aren't known, with their reaches."""

    def new(x: np.ndarray) -> np.ndarray:
        return x[np.array([all(np.linalg.norm(p - m.at) > m.reach for m in known) for p in x], bool)]

    at = starts
    for _ in range(25):
        if not len(at := new(at)):
            return []
        to = stepped(data, at, bandwidth, columns)
        to = np.where(np.isfinite(to), to, at)
        moved = np.sqrt(((to - at) ** 2).sum(1))
        # rows that are at about one place by now go on as one
        at = to[np.unique(np.round(to / bandwidth, 6), axis=0, return_index=True)[1]]
        if moved.max() <= 1e-4 * bandwidth:
            break
    apart: list[np.ndarray] = []
    for x in new(at):
        if all(np.linalg.norm(x - y) > 1e-2 * bandwidth for y in apart):
            apart.append(x)
    if not apart:
        return []
    at = np.array(apart)
    to = stepped(data, at, bandwidth, columns)
    off = np.sqrt(((to - at) ** 2).sum(1))
    radii = RADII * bandwidth
    found = []
    for x, drift, b in zip(at, off, spreads(data, at, to, np.tile(radii, (len(at), 1)), bandwidth, columns), strict=True):
        fit = np.flatnonzero(b + drift <= 0.97 * radii)
        if not len(fit) or not np.isfinite(drift):
            continue
        reach = radii[fit[-1]]
        grid, bound = np.concatenate(([0.0], radii[: fit[-1] + 1])), np.concatenate(([0.0], b[: fit[-1] + 1]))
        # between radii, a convex bound is below its chord; where a row stops by the tolerance, or when its steps are used up
        stop = left = reach
        for _ in range(200):
            stop = min(stop, tolerance + drift + float(np.interp(stop, grid, bound)))
        for _ in range(max_iterations - 1):
            left = min(left, drift + float(np.interp(left, grid, bound)))
        if max(stop, left) <= bandwidth / 8 and all(np.linalg.norm(x - m.at) > m.reach for m in [*known, *found]):
            found.append(Mode(x, reach * (1 - 1e-9), max(stop, left)))
    return found


def _points(sample: np.ndarray) -> np.ndarray:
    """Centres of a sample by a few of Lloyd's iterations."""
    centres = sample[: min(POINTS, max(16, len(sample) // 8))]
    for _ in range(8):
        near = _by_products(sample, centres, False).argmin(1)
        held = np.bincount(near, minlength=len(centres))
        member = np.zeros((len(sample), len(centres)))
        member[np.arange(len(sample)), near] = 1.0
        centres = (member.T @ sample)[held > 0] / held[held > 0, None]
    return centres


def attracted(rows: DataFrame, bandwidth: float, max_iterations: int, tolerance: float, columns: list[str] = NAMES) -> tuple[list[Mode], DataFrame]:
    """Modes, and rows (id, seq, columns) with `mode`: the number of that they surely climb to, else -1. Goes on in rounds, as
    long as each of them settles half of the rows that the one before left."""
    rest = stored(rows.select("id", "seq", *columns))
    data, modes, settled = rest.select(*columns), [], []
    schema = ", ".join(f"{c} {t}" for c, t in rest.dtypes) + ", mode int"
    n = rest.count()
    for _ in range(ROUNDS):
        if n <= min(FEW, 2 * STARTS):
            break
        share = min(1.0, 4 * SAMPLE / n)
        drawn = rest.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).select(*columns).limit(SAMPLE).toPandas().to_numpy(float).reshape(-1, len(columns))
        if not len(drawn):
            break
        modes = modes + _modes(data, drawn[:STARTS], modes, bandwidth, max_iterations, tolerance, columns)
        if not modes:
            break
        at, reach = np.array([m.at for m in modes]), np.array([m.reach for m in modes])
        drawn = drawn[~(_by_products(drawn, at) <= reach).any(1)]
        balls, within, ends = at, reach, np.arange(len(modes))
        if len(drawn) and max_iterations > 1:
            points = _points(drawn)
            to = stepped(data, points, bandwidth, columns)
            points, to = points[np.isfinite(to).all(1)], to[np.isfinite(to).all(1)]
        else:
            points = np.zeros((0, len(columns)))
        if len(points):
            # a row outside the reach that a step takes inside by more than the tolerance doesn't stop there
            room = reach - tolerance - _by_products(to, at)
            end = room.argmax(1)
            radii = reach[end][:, None] * PARTS
            fit = spreads(data, points, to, radii, bandwidth, columns) <= room[np.arange(len(points)), end][:, None] * (1 - 1e-9)
            radius = np.where(fit, radii, 0.0).max(1)
            use = radius > 0
            balls, within, ends = np.concatenate((at, points[use])), np.concatenate((reach, radius[use] * (1 - 1e-9))), np.concatenate((ends, end[use]))

        def judged(parts: Iterator[pd.DataFrame], balls: np.ndarray = balls, within: np.ndarray = within, ends: np.ndarray = ends) -> Iterator[pd.DataFrame]:
            for part in parts:
                mode = np.full(len(part), -1, np.int32)
                x = part[columns].to_numpy(float)
                for i in range(0, len(x), 4096):
                    inside = _by_products(x[i : i + 4096], balls) <= within
                    mode[i : i + 4096] = np.where(inside.any(1), ends[inside.argmax(1)], -1)
                yield part.assign(mode=mode)

        now = stored(rest.mapInPandas(judged, schema))
        settled.append(now.filter("mode >= 0"))
        rest, before = now.filter("mode < 0").drop("mode"), n
        n = rest.count()
        if n > before / 2:
            break
    out = rest.withColumn("mode", F.lit(-1))
    for part in settled:
        out = out.union(part)
    return modes, out
