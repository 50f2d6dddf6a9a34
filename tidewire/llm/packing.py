"""Operator 5: packing token pieces into as few sequences of a fixed size as possible.

A document's ids (with the end id) longer than the size are cut into pieces of that size; the first piece may be
shorter. Only the histogram of piece lengths reaches the driver, at most `size` numbers, whatever the corpus:

1. Configuration linear program: a configuration is a multiset of lengths that fits a sequence; cover all pieces with
   the least total of configurations. Multiplicative weights solve it: lengths not yet covered weigh more, and a
   knapsack dynamic program prices the best configuration under the present weights.
2. Rounding: configurations are used a whole number of times, as far as pieces remain, the most used first; what is
   left is filled sequence by sequence by a bounded knapsack that starts with the longest piece. Plain best-fit
   decreasing over the histogram is computed too and taken if it needs fewer sequences.

Placing is a join: pieces are numbered within their length (within a partition first, then with the partitions' counts
summed up, so that a frequent length is no hot group), and the number tells the sequence and the offset.

Null texts are empty: one piece, the end id. Repeated rows are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.chunks import json_tokenizer
from tidewire.llm.common import map_arrow, text_of, written
from tidewire.llm.textscan import slices

SIZE, ROUNDS = 1024, 60
#: How near the best price a configuration is used; the weights' share of a price (the rest is the length, so that full
#: sequences stay dearest) and how fast they fall; what part of the need one use covers.
EPSILON, WEIGHT, RATE, PART = 0.0005, 0.001, 3.0, 0.1


def cut_pieces(documents: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece, written once."""
    more = ", ids array<int>" if with_ids else ""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = json_tokenizer(tokenizer)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                ids, counts = encoder.encode(data, offsets)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                bounds = np.concatenate(([0], np.cumsum(counts)))
                n = -(-counts // size)
                owner = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                first = counts - (n - 1) * size
                start = np.where(piece == 0, 0, first[owner] + (piece - 1) * size)
                length = np.where(piece == 0, first[owner], size)
                at = bounds[owner] + start
                raw = ids.tobytes()
                crc = [zlib.crc32(raw[4 * s : 4 * (s + m)]) for s, m in zip(at.tolist(), length.tolist(), strict=True)]
                out = {"doc_id": batch.column("doc_id")[a:b].take(pa.array(owner)), "piece": piece.astype(np.int32), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    cut = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).transform(map_arrow, pieces, "doc_id long, piece int, start long, length long, ids_crc32 long" + more)
    return written(cut.withColumn("part", F.spark_partition_id()))


def _best_fill(sizes: np.ndarray, gains: np.ndarray, limits: np.ndarray, room: int) -> dict[int, int]:
    """The configuration of greatest gain (bounded knapsack over binary bundles of each length)."""
    bundles = []
    for i, s in enumerate(sizes.tolist()):
        left, k = min(int(limits[i]), room // s), 1
        while left > 0:
            k = min(k, left)
            bundles.append((i, k, s * k))
            left -= k
            k *= 2
    best = np.zeros(room + 1)
    took = np.zeros((len(bundles), room + 1), bool)
    for b, (i, k, w) in enumerate(bundles):
        new = best[: room + 1 - w] + gains[i] * k
        better = new > best[w:] + 1e-12
        took[b, w:] = better
        best[w:][better] = new[better]
    out: Counter[int] = Counter()
    c = int(np.argmax(best))
    for b in range(len(bundles) - 1, -1, -1):
        if took[b, c]:
            i, k, w = bundles[b]
            out[int(sizes[i])] += k
            c -= w
    return dict(out)


def _price(sizes: np.ndarray, gains: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to `room`: the greatest gain of lengths used any number of times, and the one to take first
    (-1: leave a place free)."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right").tolist()
    for c in range(int(sizes[0]), room + 1):
        fit = fits[c]
        value = best[c - sizes[:fit]] + gains[:fit]
        i = value.argmax()
        best[c], last[c] = (value[i], i) if value[i] >= best[c - 1] else (best[c - 1], -1)
    return best, last


def solve_configurations(histogram: dict[int, int], size: int, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], float]]:
    """(configuration, times used) of an approximate solution of the configuration program.

    Each round the dynamic program gives, for every length, the best configuration that holds it; those within EPSILON
    of the best of all are used for a part of what their scarcest length needs. The weights fall with what is covered.
    """
    sizes = np.array(sorted(histogram))
    need = np.array([histogram[s] for s in sizes.tolist()], float)
    covered, used = np.zeros(len(sizes)), Counter()
    for _ in range(rounds):
        gains = sizes / size * (1 + WEIGHT * np.exp(-RATE * covered / need))
        best, last = _price(sizes, gains, size)
        worth = gains + best[size - sizes]
        for first in np.flatnonzero((worth >= (1 - EPSILON) * worth.max()) & (covered < need)).tolist():
            config, c = Counter([first]), size - int(sizes[first])
            while c > 0:
                if last[c] < 0:
                    c -= 1
                else:
                    config[int(last[c])] += 1
                    c -= int(sizes[last[c]])
            amount = min((need[i] - covered[i]) / k for i, k in config.items())
            if amount > 0:
                amount = max(amount * PART, min(amount, 0.5))
                used[tuple(sorted(((int(sizes[i]), k) for i, k in config.items()), reverse=True))] += amount
                for i, k in config.items():
                    covered[i] += amount * k
        if (covered >= need - 1e-9).all():
            break
    return list(used.items())


def best_fit_decreasing(histogram: dict[int, int], size: int) -> Counter:
    """Configurations of best-fit decreasing; equal sequences are handled together."""
    open_: dict[int, Counter] = {}  # free room: configurations
    done: Counter = Counter()
    for s in sorted(histogram, reverse=True):
        left = histogram[s]
        while left:
            room = min((r for r in open_ if r >= s), default=None)
            if room is None:
                k = size // s
                whole, rest = divmod(left, k)
                for times, m in ((whole, k), (1 if rest else 0, rest)):
                    if times:
                        open_.setdefault(size - m * s, Counter())[((s, m),)] += times
                break
            config, times = next(iter(open_[room].items()))
            m = min(room // s, left)
            use = min(times, left // m)
            open_[room][config] -= use
            if not open_[room][config]:
                del open_[room][config]
            if not open_[room]:
                del open_[room]
            open_.setdefault(room - m * s, Counter())[(*config, (s, m))] += use
            left -= use * m
    for configs in open_.values():
        done.update(configs)
    return done


def lower_bound(histogram: dict[int, int], size: int = SIZE) -> int:
    """Sequences that no packing can do without: the greatest value of the configuration program's dual over a family of
    feasible prices. For each t up to half the size, lengths over size - t cost a whole sequence, those over half need one
    each, and those from t on need the room that these leave; shorter ones cost nothing."""
    count = np.zeros(size + 1, np.int64)
    for s, n in histogram.items():
        count[s] = n
    total = count * np.arange(size + 1)
    half, best = size // 2, 0
    for t in range(half + 1):
        large, over = count[size - t + 1 :].sum(), slice(half + 1, size - t + 1)
        room = count[over].sum() * size - total[over].sum()
        rest = total[t : half + 1].sum() - room
        best = max(best, int(large + count[over].sum() + max(0, -(-int(rest) // size))))
    return best


def pack_histogram(histogram: dict[int, int], size: int = SIZE, rounds: int = ROUNDS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(configuration as (length, times) pairs, number of sequences): every piece is in one."""
    if not histogram:
        return []
    left, plan = Counter(histogram), Counter()
    if left.get(size):
        plan[((size, 1),)] = left.pop(size)
    if left:
        for config, amount in sorted(solve_configurations(dict(left), size, rounds), key=lambda x: -x[1]):
            times = min(int(amount), *(left[s] // k for s, k in config))
            if times > 0:
                plan[config] += times
                left.subtract({s: k * times for s, k in config})
        left = +left
        while left:
            longest = max(left)
            sizes = np.array(sorted(left))
            limits = np.array([left[s] - (s == longest) for s in sizes.tolist()])
            fill = Counter(_best_fill(sizes, sizes * (1 + 1e-6 * sizes), limits, size - longest)) if longest < size else Counter()
            fill[longest] += 1
            times = min(left[s] // k for s, k in fill.items())
            plan[tuple(sorted(fill.items(), reverse=True))] += times
            left.subtract({s: k * times for s, k in fill.items()})
            left = +left
    plain = best_fit_decreasing(histogram, size)
    return list((plan if sum(plan.values()) <= sum(plain.values()) else plain).items())


class Places:
    """For each length, runs of piece numbers: which sequences and offsets they get."""

    def __init__(self, plan: list[tuple[tuple[tuple[int, int], ...], int]]):
        taken: Counter[int] = Counter()
        rows, base = [], 0
        for config, times in plan:
            offset = 0
            for length, k in config:
                rows.append((length, taken[length], base, k, offset))
                taken[length] += k * times
                offset += length * k
            base += times
        self.n_sequences = base
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.base, self.times, self.offset = table.T
        #: one ascending key for (length, number)
        self.key = (self.length << 44) + self.first

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.key, (length << 44) + number, "right") - 1
        nth, copy = np.divmod(number - self.first[run], self.times[run])
        return self.base[run] + nth, self.offset[run] + copy * length


def pack_pieces(pieces: DataFrame, size: int = SIZE, rounds: int = ROUNDS) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (with length and part)."""
    counts = written(pieces.groupBy("part", "length").count())
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    places = Places(pack_histogram(histogram, size, rounds))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")
    ahead = counts.select("part", "length", before.alias("ahead"))
    number = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = pieces.withColumn("number", number - 1).join(ahead, ["part", "length"]).withColumn("number", F.col("number") + F.col("ahead"))
    names = [c for c in pieces.columns if c != "part"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {pieces.schema[n].dataType.simpleString()}" for n in names)
    return numbered.select(*names, "number").transform(map_arrow, placed, f"{schema}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    return pack_pieces(cut_pieces(documents, tokenizer, end_id, size, with_ids), size)
