"""Operator 12: how quality filters interact: what each removes, alone, in every order, and at what price.

Five filters judge whole texts (their failure conditions; null texts are empty):

- A: fewer than 50 words (maximal runs of other bytes than space and 0x09-0x0D, case-sensitive);
- B: distinct words make up less than 65 % of the words;
- C: capitals A-Z make up more than 5 % of the code points;
- D: the text holds one of # $ % & * |
- E: the text is identical to that of a row with a smaller doc_id, whether that is removed or not.

Tasks scan the Arrow buffers: bytes are classed by a table, prefix sums of the classes are read at the rows' ends, and
distinct words come from sorted word hashes whose equal neighbours are compared byte by byte. What leaves a task is a
small row per document: a mask of failed filters and a SHA-256 digest, which stands for the text in E. Masks reduce: the
rest of the audit works on counts per part and mask, at most 32 a part, joined with a fixed table of what every order of
the filters does to every mask.

Rows that repeat a doc_id are judged each; among equal texts all rows of the smallest doc_id pass E. Rows without doc_id
never fail E, nor do they make others fail, and have no label. Several labels of a document count together: it is good
(or toxic) if any says so. Null parts are the empty string. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import map_arrow, text_of, written
from tidewire.llm.textscan import LONG_RUN, SLICE_BYTES, U64, byte_hashes, eights, equal_runs, mix, slices, words

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"
#: Words of one long text that are looked at together.
_WORDS = 1 << 17

_CAPITAL, _SYMBOL, _FIRST = 1, 2, 4
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] |= _CAPITAL
_CLASS[list(SYMBOLS.encode())] |= _SYMBOL
_CLASS[[b for b in range(256) if b & 0xC0 != 0x80]] |= _FIRST


def class_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Capitals, symbols and code points of each row, by prefix sums over parts of bounded size."""
    out = np.zeros((3, len(offsets) - 1), np.int64)
    for a in range(0, len(data), SLICE_BYTES):
        of = _CLASS[data[a : a + SLICE_BYTES]]
        at = np.clip(offsets - a, 0, len(of))
        first, last = max(0, int(np.searchsorted(offsets, a, "right")) - 1), int(np.searchsorted(offsets, a + len(of)))
        for k, bit in enumerate((_CAPITAL, _SYMBOL, _FIRST)):
            sums = np.zeros(len(of) + 1, np.int32)
            np.cumsum(of & bit != 0, out=sums[1:])
            out[k, first:last] += np.diff(sums[at[first : last + 1]])
    return out


def _firsts(data: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The positions of words, one for each distinct word of each row. Keys are hashes of row and word; where they agree,
    rows and bytes are compared."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    one, two = order[1:][same], order[:-1][same]
    size = ends[one] - starts[one]
    equal = (row[one] == row[two]) & (size == ends[two] - starts[two])
    short = equal & (size <= LONG_RUN)
    equal[short] = equal_runs(view, starts[one[short]], view, starts[two[short]], size[short])
    for i in np.flatnonzero(equal & (size > LONG_RUN)).tolist():
        equal[i] = np.array_equal(data[starts[one[i]] : ends[one[i]]], data[starts[two[i]] : ends[two[i]]])
    repeated = np.zeros(len(keys), bool)
    repeated[one[equal]] = True
    if not equal.all():  # different words of one hash: their whole groups again, by their bytes
        for key in np.unique(keys[one[~equal]]).tolist():
            seen = set()
            for i in np.flatnonzero(keys == U64(key)).tolist():
                word = (int(row[i]), data[starts[i] : ends[i]].tobytes())
                repeated[i] = word in seen
                seen.add(word)
    return np.flatnonzero(~repeated)


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes=byte_hashes) -> np.ndarray:
    """How many different words each row has. rows: the first word of each row, and the end."""
    view, held, pending, n = eights(data), np.zeros(0, np.int64), [], 0
    of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))

    def reduced(at: np.ndarray) -> np.ndarray:
        keys = hashes(data, starts[at], ends[at], view=view) + mix(of[at].astype(U64))
        return at[_firsts(data, view, starts[at], ends[at], of[at], keys)]

    for a in range(0, len(starts), _WORDS):
        pending.append(reduced(np.arange(a, min(a + _WORDS, len(starts)))))
        n += len(pending[-1])
        if n > len(held) and len(starts) > _WORDS:
            held, pending, n = reduced(np.concatenate((held, *pending))), [], 0
    kept = reduced(np.concatenate((held, *pending))) if len(held) else np.concatenate((held, *pending))
    return np.bincount(of[kept], minlength=len(rows) - 1)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in slices(batch.column("text")):
            capitals, symbols, points = class_counts(data, offsets)
            starts, ends, rows = words(data, offsets)
            n = np.diff(rows)
            fails = [n < LEAST_WORDS, 100 * distinct_words(data, starts, ends, rows) < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, symbols > 0]
            whole = memoryview(np.ascontiguousarray(data))
            digests = [hashlib.sha256(whole[i:j]).digest() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            mask = sum(f.astype(np.int32) << k for k, f in enumerate(fails))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[a:b], "part": batch.column("part")[a:b], "fails": mask, "digest": pa.array(digests, pa.binary())})


def failures(documents: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and fails, a row per document: bit i of fails says that the document fails filter LETTERS[i]."""
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    scanned = written(map_arrow(read, _scanned, "doc_id long, part string, fails int, digest binary"))
    repeats = written(scanned.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return scanned.join(repeats, "digest", "left").select("doc_id", "part", F.col("fails").bitwiseOR(copy * 16).alias("fails"))


def _effects(df: DataFrame) -> DataFrame:
    """What each step of each order does to a document that fails a mask of filters, and the filter's part of the 120
    orders that it removes such a document in: 120 x 5 x 32 rows, whatever the input."""
    rows = []
    for order in permutations(range(5)):
        for step, letter in enumerate(order):
            before = sum(1 << k for k in order[:step])
            for fails in range(32):
                own, earlier = bool(fails >> letter & 1), bool(fails & before)
                rows.append(("".join(LETTERS[k] for k in order), step + 1, fails, not own and not earlier, own and not earlier, own and earlier, fails == 1 << letter, 120 // fails.bit_count() if own else 0))
    names = ["filter_order", "step", "fails", "kept", "removed", "redundant", "unique_fails", "shapley"]
    columns = dict(zip(names, zip(*rows, strict=True), strict=True))
    types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
    arrays = [pa.array(list(columns[n]) if n in names[:3] else [int(x) for x in columns[n]], t) for n, t in zip(names, types, strict=True)]
    return df.sparkSession.createDataFrame(pa.Table.from_arrays(arrays, names=names))


def interactions(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit, a row per part, order of the filters and step: see the module's text."""

    def any_of(condition: Column) -> Column:
        return F.max(F.coalesce(condition, F.lit(False)).cast("long"))

    label = written(labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(any_of(F.col("quality") == 1).alias("good"), any_of(F.col("toxic") == 1).alias("toxic")))
    masks = judged.join(label, "doc_id", "left").groupBy("part", "fails").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    effects = F.broadcast(_effects(judged))  # of fixed size

    def total(effect: str, of: str = "n") -> Column:
        return F.sum(F.col(effect) * F.col(of))

    totals = {c: total(c) for c in ("kept", "removed", "redundant", "unique_fails")} | {"good_lost": total("removed", "good"), "toxic_lost": total("removed", "toxic"), "shapley": total("shapley")}
    return masks.join(effects, "fails").groupBy("part", "filter_order", "step").agg(*[c.alias(n) for n, c in totals.items()])


def audit(documents: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    return interactions(failures(documents, part), labels)
