"""What rows reach by links of at most a length: components of all rows, rows with enough others near, and labels near rows.

Rows are dealt to few large leaves of a box tree (neighbours.place), cut by columns of many values first. A part of a leaf
finds its own components, by boxes that are compared only while they may join something. Its larger components, and what
is left in small boxes, are units: their bounds go to the driver (at most UNITS or two for each part) and make a tree over
all units. The first and last rows of near units are linked, which joins most of what lies close; then all rows visit those units of
other parts alone that are near enough and don't hold their own component only, which makes it exact. Labels are changed by
small tables of links, and nothing is listed pair by pair.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators import neighbours
from tidewire.operators.graph import components
from tidewire.operators.neighbours import Tree, box_distances, boxes, distances_of, place, within
from tidewire.operators.stored import stored

#: Units on the driver, of which a part of a leaf has UNITS_A_PART at most; leaves hold so many times neighbours.LEAF rows.
UNITS, UNITS_A_PART, WIDER = 1 << 17, 256, 32


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0 to n - 1 can reach by the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cells(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Rows in boxes, and the boxes' bounds."""
    held = boxes(x, 2 * neighbours.BOX)
    return held, np.array([x[b].min(0) for b in held]), np.array([x[b].max(0) for b in held])


def _gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """From a box to boxes; what rounding may add is taken off."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0.0)
    return np.sqrt((gap * gap).sum(1)) * (1 - 1e-12)


def _counted(x: np.ndarray, height: float, least: int) -> np.ndarray:
    """How many others each row has within the height, or at least `least`."""
    n = np.zeros(len(x), np.int64)
    held, low, high = _cells(x)
    for i, box in enumerate(held):
        n[box] = within(x[box], x[box], height).sum(1) - 1
        todo = box[n[box] < least]
        if len(todo):
            gaps = _gaps(x[todo].min(0), x[todo].max(0), low, high)
            for j in np.argsort(gaps, kind="stable").tolist():
                if gaps[j] > height or not len(todo):
                    break
                if j != i:
                    near = todo[box_distances(x[todo], low[j], high[j]) <= height]
                    if len(near):
                        n[near] += within(x[near], x[held[j]], height).sum(1)
                        todo = todo[n[todo] < least]
    return n


def _groups(near: np.ndarray) -> np.ndarray:
    """Numbers of the components of a symmetric matrix of links."""
    label, c = np.full(len(near), -1), 0
    while len(left := np.flatnonzero(label < 0)):
        new = near[left[0]].copy()
        new[left[0]] = True
        while len(new := np.flatnonzero(new & (label < 0))):
            label[new] = c
            new = near[new].any(0)
        c += 1
    return label


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct pairs of numbers, as two rows."""
    if not len(a):
        return np.zeros((2, 0), np.int64)
    wide = int(b.max()) + 1
    return np.stack(np.divmod(np.unique(a * wide + b), wide))


def _components(x: np.ndarray, height: float) -> np.ndarray:
    """The first row that each row reaches."""
    held, low, high = _cells(x)
    node, above = np.zeros(len(x), np.int64), []
    for box in held:
        joined = np.sqrt((np.ptp(x[box], axis=0) ** 2).sum()) * (1 + 1e-12) <= height
        of = np.zeros(len(box), np.int64) if joined else _groups(within(x[box], x[box], height))
        node[box] = len(above) + of
        above += range(len(above), len(above) + int(of.max()) + 1)

    def root(a: int) -> int:
        while above[a] != a:
            above[a] = a = above[above[a]]
        return a

    nodes = [np.unique(node[box]).tolist() for box in held]
    for i, box in enumerate(held):
        gaps = _gaps(low[i], high[i], low[:i], high[:i])
        for j in np.argsort(gaps, kind="stable").tolist():
            if gaps[j] > height:
                break
            if len({root(a) for a in (*nodes[i], *nodes[j])}) == 1:
                continue
            u = box[box_distances(x[box], low[j], high[j]) <= height]
            v = held[j][box_distances(x[held[j]], low[i], high[i]) <= height]
            if len(u) and len(v):
                a, b = np.nonzero(within(x[u], x[v], height))
                for p, q in _pairs(node[u[a]], node[v[b]]).T.tolist():
                    above[root(p)] = root(q)
    top = np.array([root(a) for a in range(len(above))], np.int64)[node] if len(x) else node
    first = np.full(len(above), len(x))
    np.minimum.at(first, top, np.arange(len(x)))
    return first[top]


def _links(x: np.ndarray, u: np.ndarray, y: np.ndarray, v: np.ndarray, n: int, height: float) -> np.ndarray:
    """Roots of the numbers 0 to n - 1, which u and v are of the rows x and y, by links between x and y."""
    root = np.arange(n)
    held, low, high = _cells(y)
    for box, lo, hi in zip(held, low, high, strict=True):
        near = np.flatnonzero(box_distances(x, lo, hi) <= height)
        for i in range(0, len(near), 512):
            at, there = near[i : i + 512], root[v[box]]
            if (there == there[0]).all():
                at = at[root[u[at]] != there[0]]
            if len(at):
                a, b = np.nonzero(within(x[at], y[box], height))
                pairs = _pairs(root[u[at[a]]], there[b])
                if (pairs[0] != pairs[1]).any():
                    root = roots(n, *pairs)[root]
    return root


def labelled(part: pd.DataFrame, columns: list[str], height: float, most: int) -> pd.DataFrame:
    """Adds label, the smallest seq that a row reaches within the part, and unit, of which there are at most so many."""
    part = part.sort_values("seq")
    x = part[columns].to_numpy(float)
    root = _components(x, height)
    size = np.bincount(root, minlength=len(x))
    large = np.argsort(-size, kind="stable")[: most // 2]
    unit = np.full(len(x), -1)
    for i, c in enumerate(large):
        unit[root == c] = i
    rest = np.flatnonzero(unit < 0)
    if len(rest):  # boxes of neighbouring rows of many small components
        held = boxes(x[rest], max(1, -(-len(rest) * 2 // most)))
        for i, box in enumerate(held):
            unit[rest[box]] = len(large) + i * (most - most // 2) // len(held)
    return part.assign(label=part["seq"].to_numpy()[root], unit=unit).sort_values("unit", kind="stable")


def placed_in(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, neighbours.Leaves, int]:
    """Rows in few large leaves, cut by columns of many values first, so that rows that differ in one of few values lie in
    one leaf; and how many units each part may have."""
    placed, leaves = place(rows, "seq", columns, WIDER, max(1, UNITS // UNITS_A_PART), 4 * neighbours.PART, True)
    return placed, leaves, int(np.clip(UNITS // max(1, leaves.parts.sum()), 2, UNITS_A_PART))


def over(low: np.ndarray, high: np.ndarray) -> Tree:
    """A tree whose leaves are the given boxes, cut at the median of their middles."""
    middle, nodes, todo = low / 2 + high / 2, [], [(np.arange(len(low)), -1, 0)]
    while todo:
        at, above, side = todo.pop()
        node = len(nodes)
        nodes.append([0, 0, at[0] if len(at) == 1 else -1])
        if above >= 0:
            nodes[above][side] = node
        if len(at) > 1:
            order = at[np.argsort(middle[at, (middle[at].max(0) - middle[at].min(0)).argmax()], kind="stable")]
            todo += [(order[: len(at) // 2], node, 0), (order[len(at) // 2 :], node, 1)]
    left, right, leaf = (np.array(c) for c in zip(*nodes, strict=True))
    return Tree(np.zeros(len(leaf), int), np.zeros(len(leaf)), left, right, leaf).fitted(low, high)


class Reach:
    """Rows (seq, which is unique, columns and label, their component within their part) by their unit, in _leaf. pieces:
    tables of rows with label, _leaf, _part and unit; parts of different tables are different parts."""

    def __init__(self, pieces: list[DataFrame], height: float, columns: list[str]):
        self.columns, self.height, self.merged = list(columns), height, []
        self.typed = ", ".join(f"{c} double" for c in self.columns)
        of_part = lambda i: (F.col("_leaf") + i * neighbours.LEAVES) * (1 << 32) + F.col("_part")
        kept = [p.select("seq", *self.columns, "label", (of_part(i) * UNITS_A_PART + F.col("unit")).alias("_leaf")) for i, p in enumerate(pieces)]
        self.rows = functools.reduce(DataFrame.union, kept)
        units = self.rows.groupBy("_leaf").agg(*[F.min(c).alias(f"low_{c}") for c in self.columns], *[F.max(c).alias(f"high_{c}") for c in self.columns]).toPandas()
        self.units = units["_leaf"].to_numpy(np.int64)
        low, high = (units[[f"{s}_{c}" for c in self.columns]].to_numpy(float) for s in ("low", "high"))
        self.low, self.high, self.tree = low, high, over(low, high) if len(units) else None

    def _nodes(self) -> tuple[np.ndarray, np.ndarray]:
        """The one label of each unit and node of the tree, -1 where they have several."""
        of = self.rows.groupBy("_leaf").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low = high").toPandas().set_index("_leaf")["low"]
        of = of.reindex(self.units, fill_value=-1).to_numpy(np.int64)
        return of, self.tree.upwards(of)

    def _firsts(self) -> DataFrame:
        """Links (a, b) of labels that join what the first and last rows of units of different parts do; a task sends no more
        than labels."""
        names, height, tree, numbers = self.columns, self.height, self.tree, self.units
        ends = [f(F.struct("label", *names), "seq").alias(n) for f, n in ((F.min_by, "a"), (F.max_by, "b"))]
        one = self.rows.groupBy("_leaf").agg(*ends).select("_leaf", *[F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in "ab" for c in ("label", *names)]).toPandas().set_index("_leaf").reindex(numbers)  # a row per unit
        x, part = [one[[f"{n}_{c}" for c in names]].to_numpy(float) for n in "ab"], numbers // UNITS_A_PART
        labels, code = np.unique(one[["a_label", "b_label"]].to_numpy(np.int64).T, return_inverse=True)
        code = code.reshape(2, -1)

        def links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            root = np.arange(len(labels))
            for block in parts:
                found = [np.zeros((2, 0), np.int64)]
                for i in block["id"].tolist():
                    for y, own in zip((x[0][i], x[1][i]), code[:, i], strict=True):
                        near = tree.close(y, y, height)
                        near = near[part[near] != part[i]]
                        for side, other in zip(x, code, strict=True):
                            linked = np.unique(other[near[distances_of(side[near] - y) <= height]])
                            found.append(np.stack((np.full(len(linked), own), linked)))
                root = roots(len(root), *root[np.concatenate(found, axis=1)])[root]
            moved = np.flatnonzero(root != np.arange(len(root)))
            yield pd.DataFrame({"a": labels[moved], "b": labels[root[moved]]})

        tasks = max(1, min(len(numbers) // 512, 256))
        return self.rows.sparkSession.range(0, len(numbers), 1, tasks).mapInPandas(links, "a long, b long").filter("a <> b").distinct()

    def _asked(self, asking: DataFrame) -> DataFrame:
        """Visits of rows (seq, label, columns, _leaf) to units of other parts that may hold other labels: of each two parts
        the later one asks."""
        names, height, tree, numbers, low, high = self.columns, self.height, self.tree, self.units, self.low, self.high
        label_of, of_node = self._nodes()

        def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for block in parts:
                x, label, home = block[names].to_numpy(float), block["label"].to_numpy(np.int64), block["_leaf"].to_numpy(np.int64)
                order = np.argsort(home, kind="stable")
                who, unit = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for at in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
                    own = label[at[0]] if (label[at] == label[at[0]]).all() else None
                    found = tree.close(x[at].min(0), x[at].max(0), height, own, of_node)
                    part = numbers[found] // UNITS_A_PART
                    here = home[at[0]] // UNITS_A_PART
                    found = found[part < here]
                    if len(at) < len(found):
                        for i in at.tolist():
                            far = _gaps(x[i], x[i], low[found], high[found])
                            near = np.flatnonzero((far <= height) & (label_of[found] != label[i]))
                            who.append(np.full(len(near), i))
                            unit.append(found[near])
                    else:
                        for u in found.tolist():
                            near = at[(box_distances(x[at], low[u], high[u]) <= height) & (label[at] != label_of[u])]
                            who.append(near)
                            unit.append(np.full(len(near), u))
                who, unit = np.concatenate(who), np.concatenate(unit)
                for i in range(0, len(who), 1 << 14):
                    yield block.iloc[who[i : i + (1 << 14)]][["seq", "label", *names]].assign(_leaf=numbers[unit[i : i + (1 << 14)]])

        return asking.select("seq", "label", *names, "_leaf").mapInPandas(visits, f"seq long, label long, {self.typed}, _leaf long")

    def near(self, asking: DataFrame) -> DataFrame:
        """Visits of rows (seq, columns) to all units near enough."""
        names, tree, reach, numbers = self.columns, self.tree, np.nextafter(self.height, np.inf), self.units

        def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for i in range(0, len(part), 4096):
                    block = part.iloc[i : i + 4096]
                    who, unit = tree.nearer(block[names].to_numpy(float), np.full(len(block), reach))
                    yield block.iloc[who][["seq", "label", *names]].assign(_leaf=numbers[unit])

        return asking.select("seq", F.lit(-1).cast("long").alias("label"), *names).mapInPandas(visits, f"seq long, label long, {self.typed}, _leaf long")

    def visited(self, asked: DataFrame, work: Callable[[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
        """What work makes of the visitors of each unit and its rows: (seq, label) and the columns as a matrix, of both."""
        names = self.columns
        asked = stored(asked)
        chunks = F.broadcast(stored(asked.groupBy("_leaf").agg(F.ceil(F.count("*") / neighbours.CHUNK).alias("_chunks"))))  # a row per unit
        visitors = asked.join(chunks, "_leaf").withColumn("_chunk", F.pmod(F.xxhash64("seq"), F.col("_chunks"))).drop("_chunks")
        there = self.rows.join(chunks, "_leaf").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks")
        kept = ["_leaf", "_chunk", "seq", "label", F.array(*names).alias("x")]  # few columns, as groups are small

        def run(visiting: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
            x, y = (np.concatenate(part["x"].tolist()).reshape(-1, len(names)) if len(part) else np.zeros((0, len(names))) for part in (visiting, here))
            return work(visiting, x, here, y)

        return visitors.select(*kept).groupBy("_leaf", "_chunk").cogroup(there.select(*kept).groupBy("_leaf", "_chunk")).applyInPandas(run, schema)

    def joined(self, links: DataFrame, components: Callable[[DataFrame], DataFrame]) -> None:
        """Joins labels by links (a, b)."""
        self.merged.append(stored(components(stored(links)).select(F.col("node").alias("label"), F.col("component").alias("into"))))
        self.rows = self.relabelled(self.rows, self.merged[-1:])

    def relabelled(self, rows: DataFrame, merged: list[DataFrame] | None = None) -> DataFrame:
        """Rows with the labels that those of the pieces have become."""
        for table in self.merged if merged is None else merged:
            rows = rows.join(table, "label", "left").withColumn("label", F.coalesce("into", "label")).drop("into")
        return rows

    def settled(self, components: Callable[[DataFrame], DataFrame] = components) -> Reach:
        """label becomes the smallest seq that a row reaches by links of at most the height: first by those between a few
        rows of units, which join most of what lies close, then by those of all rows, which makes it exact."""
        height = self.height

        def links(visiting: pd.DataFrame, x: np.ndarray, here: pd.DataFrame, y: np.ndarray) -> pd.DataFrame:
            labels, of = np.unique(np.concatenate((visiting["label"], here["label"])), return_inverse=True)
            if not len(x) or not len(y):
                return pd.DataFrame({"a": [], "b": []})
            root = _links(x, of[: len(x)], y, of[len(x) :], len(labels), height)
            moved = np.flatnonzero(root != np.arange(len(labels)))
            return pd.DataFrame({"a": labels[moved], "b": labels[root[moved]]})

        if self.tree is not None:
            self.joined(self._firsts(), components)
            self.joined(self.visited(self._asked(self.rows), links, "a long, b long").distinct(), components)
        return self


def within_reach(rows: DataFrame, height: float, columns: list[str], components: Callable[[DataFrame], DataFrame] = components) -> Reach:
    """label is the smallest seq that a row reaches by links of at most `height`. components: of links between labels."""
    columns = list(columns)
    rows = rows.select(F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in columns])
    placed, _, most = placed_in(rows, columns)
    schema = "seq long, " + ", ".join(f"{c} double" for c in columns) + ", _leaf long, _part long, label long, unit long"
    found = stored(placed.groupBy("_leaf", "_part").applyInPandas(lambda part: labelled(part, columns, height, most)[[f.split()[0] for f in schema.split(", ")]], schema))
    return Reach([found], height, columns).settled(components)


def crowded(rows: DataFrame, height: float, least: int, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(every, late). every: all rows (id, seq, columns) by _leaf and _part; those with at least so many others within the
    height in their own part have label and unit among such rows of the part (labelled), the others -1. late: of those
    others (seq and columns) the ones that have so many in the whole table."""
    columns = list(columns)
    typed = ", ".join(f"{c} double" for c in columns)
    placed, leaves, most = placed_in(rows.select("id", F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in columns]), columns)
    schema = f"id string, seq long, {typed}, _leaf long, _part long, n long, label long, unit long"

    def own(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(n=_counted(part[columns].to_numpy(float), height, least), label=-1, unit=-1)
        core = part["n"].to_numpy() >= least
        out = [part[~core], labelled(part[core], columns, height, most)] if core.any() else [part]
        return pd.concat(out)[[f.split()[0] for f in schema.split(", ")]]

    every = stored(placed.groupBy("_leaf", "_part").applyInPandas(own, schema))
    lacking = stored(every.filter(F.col("n") < least).select("seq", *columns, F.col("_leaf").alias("home"), F.col("_part").alias("home_part"), F.col("n").alias("had")))
    if not lacking.limit(1).count():
        return every, lacking.select("seq", *columns)
    # many have enough among themselves
    again, _ = place(lacking, "seq", columns, 4)
    named = f"seq long, {typed}, home long, home_part long, had long, n long"

    def among(part: pd.DataFrame) -> pd.DataFrame:
        return part.assign(n=_counted(part[columns].to_numpy(float), height, least))[[f.split()[0] for f in named.split(", ")]]

    second = stored(again.groupBy("_leaf", "_part").applyInPandas(among, named))
    # the rest visit all parts near enough
    reach = np.nextafter(height, np.inf)

    def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), 1024):
                block = part.iloc[i : i + 1024]
                who, leaf, number = leaves.every_part(*leaves.tree.nearer(block[columns].to_numpy(float), np.full(len(block), reach)))
                other = (leaf != block["home"].to_numpy()[who]) | (number != block["home_part"].to_numpy()[who])
                yield block.iloc[who[other]][["seq", *columns]].assign(_leaf=leaf[other], _part=number[other])

    rest = second.filter(F.col("n") < least)
    asked = stored(rest.mapInPandas(visits, f"seq long, {typed}, _leaf long, _part long"))
    keys = ["_leaf", "_part"]
    chunks = F.broadcast(stored(asked.groupBy(*keys).agg(F.ceil(F.count("*") / neighbours.CHUNK).alias("_chunks"))))  # a row per part
    visitors = asked.join(chunks, keys).withColumn("_chunk", F.pmod(F.xxhash64("seq"), F.col("_chunks"))).drop("_chunks")
    there = every.select("seq", *columns, *keys).join(chunks, keys).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1))).drop("_chunks")

    def met(visiting: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        x, y = visiting[columns].to_numpy(float), here[columns].to_numpy(float)
        n = np.zeros(len(x), np.int64)
        held, low, high = _cells(y) if len(x) else ([], [], [])
        for box, lo, hi in zip(held, low, high, strict=True):
            near = np.flatnonzero((n < least) & (box_distances(x, lo, hi) <= height))
            for i in range(0, len(near), 512):
                n[near[i : i + 512]] += within(x[near[i : i + 512]], y[box], height).sum(1)
        return pd.DataFrame({"seq": visiting["seq"].to_numpy(), "n": n})

    more = visitors.groupBy(*keys, "_chunk").cogroup(there.groupBy(*keys, "_chunk")).applyInPandas(met, "seq long, n long")
    found = rest.select("seq", F.col("had").alias("n")).union(more).groupBy("seq").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("seq")
    late = second.filter(F.col("n") >= least).select("seq", *columns).union(rest.join(found, "seq").select("seq", *columns))
    return every, stored(late)
