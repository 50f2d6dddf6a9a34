"""Operator 4: substring duplicates by a relative Lempel-Ziv parse.

A window is 20 consecutive words; words covered by a window whose words also start earlier (smaller doc_id, or same
document and earlier start) are duplicates.

1. Each window belongs to the block around the 8-word gram of smallest hash in it (the leftmost), a choice made by its
   words alone. A block is known by its gram's hash; the earliest block of each hash is the reference block. All
   reference blocks are indexed, by hash joins.
2. A block whose whole stretch (all its windows, by two hashes of its words) equals its reference's can be copied from
   there. Where stretches differ although their grams agree, single windows are compared by two hashes of their words,
   the references' too. A window that is duplicate but equals no reference's window stands in the table of windows
   itself, so nothing is missed.
3. Every document is parsed greedily, from the left: stretches and windows that can be copied from one document at one
   distance join, of those that begin within what is parsed already the one that reaches furthest becomes the next
   factor, and a factor may overlap the one before (so that windows across a boundary of factors count too). A factor
   holds 20 words or more; the words of factors are removed.

Only hashes, doc_ids and positions are shuffled, first the blocks whose hash occurs twice at all (a bitmap sorts out most
others), then windows at boundaries; texts are joined with their spans once, in the end.

Null texts have no words. Repeated rows with equal doc_id and text count as one document; rows of equal doc_id and
different texts are documents of their own, in the order of their texts' hashes. Rows without doc_id come back whole.
Documents of fewer than 20 words stay whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.llm.common import Bitmap, carried, map_arrow, written
from tidewire.llm.textscan import U64, WordRuns, joined, mix, slices

WINDOW, GRAM = 20, 8
#: Windows looked at together.
STEP = 1 << 18
#: Places are word numbers below 2**PLACE; above stands which of its doc_id's texts a document is.
PLACE = 40


class Blocks:
    """The blocks of a run of words: gram's hash, hash of the whole stretch, row, place in the row, number of windows,
    and the place of an equal stretch before it in the same row (-1: none)."""

    def __init__(self, runs: WordRuns, lo: int, hi: int, window: int = WINDOW, gram: int = GRAM):
        part = runs.part(lo, hi)
        n = hi - lo - window + 1
        grams, at = part.of(gram), np.arange(n)
        best, where = grams[:n].copy(), np.zeros(n, np.int8)
        for k in range(1, window - gram + 1):
            other = grams[k : k + n]
            less = other < best
            best[less], where[less] = other[less], k
        row = np.searchsorted(part.rows, at, "right") - 1
        whole = np.flatnonzero(at + window <= part.rows[row + 1])
        chosen, row = where[whole] + whole, row[whole]
        new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])))[: len(chosen)])
        self.row, self.first, self.size = row[new], whole[new] + lo, np.diff(np.append(new, len(whole)))
        self.hash = mix(grams[chosen[new]])
        self.words = runs.part(lo, hi, 1).of(window)  # of each window, another hash than the grams'
        self.lo = lo
        ends = self.words[whole[new]], self.words[whole[new] + self.size - 1]
        self.stretch = joined(*ends) ^ mix(((chosen[new] - whole[new]) * 64 + self.size).astype(U64))
        self.place = self.first - runs.rows[self.row]
        order = np.lexsort((self.first, self.stretch, self.hash, self.row))
        same = np.flatnonzero((self.row[order][1:] == self.row[order][:-1]) & (self.hash[order][1:] == self.hash[order][:-1]) & (self.stretch[order][1:] == self.stretch[order][:-1]))
        self.before = np.full(len(new), -1)
        self.before[order[same + 1]] = self.place[order[same]]


def _blocks(runs: WordRuns) -> Iterator[Blocks]:
    for lo in range(0, len(runs.starts) - WINDOW + 1, STEP):
        yield Blocks(runs, lo, min(lo + STEP + WINDOW - 1, len(runs.starts)))


def _version(text: str) -> Column:
    """Tells texts of one doc_id apart, in 23 bits."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 23) - 1))


def _scan(documents: DataFrame, schema: str, rows: Callable) -> DataFrame:
    """rows(blocks, doc_ids and versions of the slice's rows) -> columns, over the blocks of all documents that have a
    doc_id."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = batch.column("doc_id").to_numpy(), batch.column("version").to_numpy() << PLACE
            for a, b, data, offsets in slices(batch.column("text")):
                for blocks in _blocks(WordRuns(data, offsets)):
                    if len(blocks.row):
                        yield pa.RecordBatch.from_pydict(rows(blocks, ids[a:b], versions[a:b]))

    return documents.filter("doc_id is not null").select("doc_id", _version("text").alias("version"), "text").transform(map_arrow, scanned, schema)


def _mark(doc_ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    return mix(mix(doc_ids.astype(np.int64).view(U64)) + places.astype(U64))


def duplicate_spans(documents: DataFrame) -> DataFrame:
    """doc_id, place, size (words), ref_doc, ref_place: stretches and windows that can be copied, other than from their
    own document's equal stretches. Spans overlap."""

    def hashes(blocks: Blocks, *_) -> dict:
        return {"h": blocks.hash[blocks.before < 0].view(np.int64)}

    often = written(_scan(documents, "h long", hashes).groupBy("h").count().filter("count > 1").select("h"))
    listed = Bitmap.of(often, "h")

    def candidates(blocks: Blocks, doc_ids: np.ndarray, versions: np.ndarray) -> dict:
        x = np.flatnonzero((blocks.before < 0) & listed.holds(blocks.hash))
        row = blocks.row[x]
        return {"h": blocks.hash[x].view(np.int64), "stretch": blocks.stretch[x].view(np.int64), "doc_id": doc_ids[row], "place": versions[row] + blocks.place[x], "size": blocks.size[x]}

    found = written(_scan(documents, "h long, stretch long, doc_id long, place long, size int", candidates))
    refs = found.groupBy("h").agg(F.min(F.struct("doc_id", "place", "stretch", "size")).alias("r"), F.count("*").alias("n"))
    refs = written(refs.filter("n > 1").select("h", F.col("r.doc_id").alias("ref_doc"), F.col("r.place").alias("ref_place"), F.col("r.stretch").alias("ref_stretch"), F.col("r.size").alias("ref_size")))
    judged = found.join(refs, "h").filter("doc_id <> ref_doc or place <> ref_place").withColumn("copied", F.expr("stretch = ref_stretch and size = ref_size"))
    judged = written(judged.drop("h", "stretch", "ref_stretch"))
    copied = judged.filter("copied").select("doc_id", "place", (F.col("size") + (WINDOW - 1)).alias("size"), "ref_doc", "ref_place")

    differ = judged.filter("not copied")
    places = differ.select("doc_id", "place").union(differ.select("ref_doc", "ref_place").distinct())

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"p": _mark(batch.column("doc_id").to_numpy(), batch.column("place").to_numpy()).view(np.int64)})

    asked = Bitmap.of(written(places.transform(map_arrow, marked, "p long")), "p")

    def windows(blocks: Blocks, doc_ids: np.ndarray, versions: np.ndarray) -> dict:
        place = versions[blocks.row] + blocks.place
        x = np.flatnonzero((blocks.before < 0) & listed.holds(blocks.hash) & asked.holds(_mark(doc_ids[blocks.row], place)))
        size = blocks.size[x]
        nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        w = blocks.words[np.repeat(blocks.first[x] - blocks.lo, size) + nth]
        return {"h": np.repeat(blocks.hash[x], size).view(np.int64), "w": w.view(np.int64), "doc_id": np.repeat(doc_ids[blocks.row[x]], size), "place": np.repeat(place[x], size) + nth}

    single = written(_scan(documents, "h long, w long, doc_id long, place long", windows))
    first = single.groupBy("h", "w").agg(F.min(F.struct("doc_id", "place")).alias("r"), F.count("*").alias("n"))
    first = written(first.filter("n > 1").select("h", "w", F.col("r.doc_id").alias("ref_doc"), F.col("r.place").alias("ref_place")))
    later = single.join(first, ["h", "w"]).filter("doc_id <> ref_doc or place <> ref_place")
    return copied.union(later.select("doc_id", "place", F.lit(WINDOW).alias("size"), "ref_doc", "ref_place"))


def factors(row: np.ndarray, start: np.ndarray, size: np.ndarray, ref_doc: np.ndarray, ref_place: np.ndarray) -> np.ndarray:
    """The greedy parse of each row by what can be copied: an array of (row, start, end, source document, source place).

    What goes on in the same source at the same distance joins; then, from the left, the one that reaches furthest of
    those that begin within the factors so far (or else the next one) is the next factor.
    """
    shift = ref_place - start
    order = np.lexsort((start, shift, ref_doc, row))
    row, start, end, ref_doc, shift = row[order], start[order], (start + size)[order], ref_doc[order], shift[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (shift[1:] != shift[:-1])
    # within a distance, ends ascend with starts but for stretches and windows that overlap
    top = end + np.cumsum(new) * (1 << PLACE)
    new[1:] |= start[1:] + np.cumsum(new)[1:] * (1 << PLACE) > np.maximum.accumulate(top)[:-1]
    first = np.flatnonzero(new)
    if not len(first):
        return np.zeros((0, 5), np.int64)
    chains = np.stack((row[first], start[first], np.maximum.reduceat(end, first), ref_doc[first], start[first] + shift[first]), 1)
    chains = chains[np.lexsort((-chains[:, 2], chains[:, 1], chains[:, 0]))]
    out, best, reach, at = [], None, 0, -1
    listed = chains[:, :3].tolist()
    for i, (r, s, e) in enumerate(listed):
        if r != at:
            if best is not None:
                out.append(best)
            best, reach, at = None, -1, r
        if s > reach and best is not None:
            out.append(best)
            best, reach = None, listed[best][2]
        if s > reach:
            out.append(i)
            reach = e
        elif e > reach and (best is None or e > listed[best][2]):
            best = i
    if best is not None:
        out.append(best)
    return chains[out]


def _kept(raw: bytes, runs: WordRuns, stay: np.ndarray) -> bytes:
    """The words that stay, joined by one space; runs parted by one space already are copied as they are."""
    if not len(stay):
        return b""
    data = runs.data
    new = np.ones(len(stay), bool)
    gap = runs.ends[stay[:-1]]
    new[1:] = (np.diff(stay) != 1) | (runs.starts[stay[1:]] - gap != 1) | (data[np.minimum(gap, len(data) - 1)] != 0x20)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(stay)) - 1
    return b" ".join([raw[s:e] for s, e in zip(runs.starts[stay[first]].tolist(), runs.ends[stay[last]].tolist(), strict=True)])


def remove_duplicates(documents: DataFrame, columns: list[str] | tuple[str, ...] = ("kept_sha256",), carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, n_factors, and of `columns` any of kept_sha256, kept (the words that stay, joined by
    one space; null for null texts), cut (the same, but the text itself where nothing is removed). carry: columns of the
    documents, whatever their names, that come along as a struct named documents."""
    kinds = {"kept": "string", "cut": "string", "kept_sha256": "string"}
    others = [*carry, *(c for c in columns if c not in kinds)]
    spans = duplicate_spans(documents).withColumn("version", F.shiftright("place", PLACE)).withColumn("place", F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)))
    by_doc = spans.groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).agg(F.collect_list(F.struct("place", "size", "ref_doc", "ref_place")).alias("_spans"))
    rows = documents.select("doc_id", "text", carried(documents, others))
    joined_ = rows.join(by_doc, (F.col("doc_id") == F.col("_doc")) & (_version("text") == F.col("_version")), "left").drop("_doc", "_version")
    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, n_factors long" + "".join(f", {c} {kinds[c]}" for c in columns if c in kinds))
    if others:
        schema.add(rows.schema["documents"])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            null, has_id = pc.is_null(batch.column("text")).to_pylist(), pc.is_valid(batch.column("doc_id")).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy()
            for a, b, data, offsets in slices(batch.column("text")):
                runs = WordRuns(data, offsets)
                lists = batch.column("_spans")[a:b]
                found, owner = lists.flatten(), np.repeat(np.arange(b - a), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                copies = [[owner], *([found.field(c).to_numpy().astype(np.int64)] for c in ("place", "size", "ref_doc", "ref_place"))]
                for blocks in _blocks(runs):  # and what repeats within its own document, but never in rows without doc_id
                    own = np.flatnonzero((blocks.before >= 0) & has_id[a:b][blocks.row])
                    for x, more in zip(copies, (blocks.row, blocks.place, blocks.size + WINDOW - 1, ids[a:b][blocks.row], blocks.before), strict=True):
                        x.append(more[own])
                row, start, end, *_ = (parse := factors(*map(np.concatenate, copies))).T
                rows = runs.rows
                change = np.bincount(rows[row] + start, minlength=len(runs.starts) + 1) - np.bincount(rows[row] + end, minlength=len(runs.starts) + 1)
                gone = np.cumsum(change[:-1]) > 0
                removed = np.concatenate(([0], np.cumsum(gone)))
                raw = data.tobytes()
                texts = [_kept(raw, runs, np.flatnonzero(~gone[i:j]) + i) for i, j in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
                out = {"doc_id": batch.column("doc_id")[a:b], "n_words": np.diff(rows), "n_removed": np.diff(removed[rows]), "n_factors": np.bincount(parse[:, 0], minlength=b - a), "documents": batch.column("documents")[a:b]}
                if "kept_sha256" in columns:
                    out["kept_sha256"] = [hashlib.sha256(t).hexdigest() for t in texts]
                if "kept" in columns:
                    out["kept"] = pa.array([None if null[a + r] else t.decode() for r, t in enumerate(texts)], pa.string())
                if "cut" in columns:
                    same = pa.array(out["n_removed"] == 0)
                    out["cut"] = pc.if_else(same, batch.column("text")[a:b], pa.array([b"" if k else t for k, t in zip(same.to_pylist(), texts, strict=True)], pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_pydict(out)

    return joined_.transform(map_arrow, cleaned, schema)
