"""Operator 3: MinHash near-duplicates by DartMinHash signatures.

A document is a weighted set: its five-word shingles (lower-case words; a document of one to four words has one
shingle of all of them) weighted by how often they occur. Two documents are linked if their weighted Jaccard
similarity (sum of minima over sum of maxima) is 0.8 or more; classes are what links connect.

1. Signatures (Christiani, DartMinHash): the plane of weight and rank over each element is cut into cells whose number
   of darts is Poisson by hash; a document gets the darts below its weights, thrown up to a rank that gives about
   K (ln K + 4) of them, each hashed to one of K coordinates, and keeps the earliest of each coordinate. A coordinate
   agrees with probability equal to the similarity. Should one stay empty, the rank is doubled.
2. Bands of ROWS coordinates meet in buckets: a pair of similarity 0.8 shares one of 32 bands with probability
   1 - 5e-8. Documents of equal words (by a cryptographic digest of them) are one representative beforehand.
3. In each bucket all are compared with the representative of smallest doc_id (a star, not all pairs) on their whole
   texts; a centre's partners are dealt to tasks by salts. Buckets that stars leave in several classes are looked at
   again, dealt as blocks: signatures tell which documents agree enough with one of another class, and only these
   documents' texts are compared inside tasks; only the links that join classes leave the task.

Null texts and texts without words are linked with nothing. Rows of equal doc_id share a class, whatever their texts;
each of their texts is compared. Rows without doc_id are their own class, with null class_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.blocks import groups
from tidewire.llm.common import Bitmap, components, map_arrow, written
from tidewire.llm.textscan import U64, WordRuns, mix, slices

K, ROWS, WORDS, SIMILARITY = 128, 4, 5, 0.8
#: Rank cells: [0, 2**-DEPTH), then doubling up to 1, then of width 1.
DEPTH = 12
#: Documents, and bytes of their texts, of a block of a large bucket and of a salt of a star.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Cells of weight and rank handled at once.
STEP = 1 << 19


def shingles(runs: WordRuns, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row of lower-case text, in order of row."""
    count = np.diff(runs.rows)
    n = np.maximum(np.minimum(count, 1), count - size + 1)
    row = np.repeat(np.arange(len(count)), n)
    first = runs.rows[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    keys, length = np.zeros(len(row), U64), np.minimum(count, size)[row]
    for k in range(1, size + 1):
        some = length == k
        if some.any():
            keys[some] = runs.of(k)[first[some]]
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])))[: len(keys)])
    return row[new], keys[new], np.diff(np.append(new, len(keys)))


def digests(data: np.ndarray, runs: WordRuns) -> list[bytes]:
    """128 bits of each row's words, equal only for equal words."""
    raw, out = data.tobytes(), []
    gaps = (runs.starts[1:] - runs.ends[:-1] != 1) | (data[np.minimum(runs.ends[:-1], len(data) - 1)] != 0x20)
    irregular = np.concatenate(([0], np.cumsum(np.append(gaps, False))))
    for a, b in zip(runs.rows[:-1].tolist(), runs.rows[1:].tolist(), strict=True):
        if a == b:
            text = b""
        elif irregular[b - 1] == irregular[a]:  # one space between all words
            text = raw[runs.starts[a] : runs.ends[b - 1]]
        else:
            text = b" ".join([raw[s:e] for s, e in zip(runs.starts[a:b].tolist(), runs.ends[a:b].tolist(), strict=True)])
        out.append(hashlib.blake2b(text, digest_size=16).digest())
    return out


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) / (1 << 53)


def dart_signatures(row: np.ndarray, keys: np.ndarray, weights: np.ndarray, rows: int, k: int = K) -> np.ndarray:
    """rows x k signature of 32-bit values; all 0 for rows without elements. weights: positive; rows ascend."""
    out = np.zeros((rows, k), np.uint32)
    total = np.bincount(row, weights, rows)
    rank = np.zeros(rows)
    rank[total > 0] = k * (np.log(k) + 4) / total[total > 0]
    # each element's weight in cells of width 1; the last may be cut
    ends = np.cumsum(np.ceil(weights).astype(np.int64))
    todo = total > 0
    while todo.any():
        earliest = np.full(rows * k, np.inf)
        for a in range(0, int(ends[-1]), STEP):
            cell = np.arange(a, min(a + STEP, int(ends[-1])))
            element = np.searchsorted(ends, cell, "right")
            some = todo[row[element]]
            cell, element = cell[some], element[some]
            nth = cell - np.where(element > 0, ends[element - 1], 0)
            room = np.minimum(1.0, weights[element] - nth)
            seed = mix(keys[element] + nth.astype(U64) * U64(0x9FB21C651E98DF25))
            for who, when, d in _darts(seed, row[element], room, rank):
                slot = who * k + ((d >> U64(32)) % U64(k)).astype(np.int64)
                np.minimum.at(earliest, slot, when)
                first = when == earliest[slot]
                out.reshape(-1)[slot[first]] = np.maximum(mix(d[first]).astype(np.uint32), 1)
        full = np.isfinite(earliest).reshape(rows, k).all(1)
        todo &= ~full
        rank[todo] *= 2
    return out


def _darts(seed: np.ndarray, owner: np.ndarray, room: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, rank, hash) of the darts over the listed cells of width 1, as far as their rows' ranks reach."""
    cut = bool((room < 1).any())

    def thrown(at: np.ndarray, cell: np.ndarray, lo: np.ndarray, width: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The darts of one rank cell of each listed cell."""
        h = mix(seed[at] ^ mix(cell * U64(0xA24BAED4963EE407)))
        u, chance, below, live, n = _uniform(h), np.exp(-width), 0.0, np.arange(len(at)), 0
        while n < 24:  # the n-th dart exists if u is beyond the chance of fewer than n
            below += chance
            live = live[u[live] >= below]
            if not len(live):
                break
            d, who = mix(h[live] + U64((n + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)), live
            if cut:
                inside = _uniform(mix(d ^ U64(0x5851F42D4C957F2D))) < room[at[live]]
                d, who = d[inside], live[inside]
            if len(who):
                start = lo[who] if len(lo) > 1 else lo
                yield owner[at[who]], start + width * _uniform(mix(d ^ U64(0x14057B7EF767814F))), d
            n += 1
            chance *= width / n

    at, lo, width, found = np.arange(len(seed)), 0.0, 2.0**-DEPTH, []
    for j in range(DEPTH + 1):
        at = at[rank[owner[at]] > lo]
        if not len(at):
            break
        found += thrown(at, np.array([j + 1], U64), np.array([lo]), width)
        lo, width = lo + width, lo + width
    at = at[rank[owner[at]] > 1]
    if len(at):  # the cells of width 1, in parts of bounded size
        more = np.ceil(rank[owner[at]] - 1).astype(np.int64)
        ends = np.cumsum(more)
        for a in range(0, int(ends[-1]), STEP):
            cell = np.arange(a, min(a + STEP, int(ends[-1])))
            where = np.searchsorted(ends, cell, "right")
            nth = cell - np.where(where > 0, ends[where - 1], 0)
            found += thrown(at[where], (nth + DEPTH + 2).astype(U64), nth + 1.0, 1.0)
    if found:
        yield tuple(np.concatenate(x) for x in zip(*found, strict=True))


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band and document."""
    parts = signatures.reshape(len(signatures), signatures.shape[1] // rows, rows).astype(U64)
    key = np.arange(1, parts.shape[1] + 1, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15)
    for i in range(rows):
        key = mix(key ^ (parts[:, :, i] + U64(i << 33)))
    return key


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string()))


def _signed(documents: DataFrame) -> DataFrame:
    """doc_id, key (a digest of the words), signature, bands, bytes of the text; only documents that have words."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(_lower(batch.column("text"))):
                runs = WordRuns(data, offsets)
                some = np.flatnonzero(np.diff(runs.rows))
                key = digests(data, runs)
                row, keys, counts = shingles(runs)
                del runs
                signatures = dart_signatures(row, keys, counts.astype(float), b - a)[some]
                bands = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(signatures).reshape(-1).view(np.int64)), K // ROWS).cast(pa.list_(pa.int64()))
                ids = batch.column("doc_id")[a:b].take(pa.array(some))
                yield pa.RecordBatch.from_pydict({"doc_id": ids, "key": [key[i] for i in some.tolist()], "signature": [s.tobytes() for s in signatures], "bands": bands, "bytes": np.diff(offsets)[some]})

    return documents.select("doc_id", "text").transform(map_arrow, signed, "doc_id long, key binary, signature binary, bands array<long>, bytes long")


def _texts(keys: DataFrame, documents: DataFrame) -> DataFrame:
    """key, text of (at least) the keys listed in a written table of key, rep (a doc_id that has that text); a bitmap
    leaves most other documents out before any shuffle."""
    listed = Bitmap.of(keys.select(F.xxhash64("rep").alias("h")), "h")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(listed.holds(batch.column("h").to_numpy())))
            text = batch.column("text")
            for a, b, data, offsets in slices(_lower(text)):
                yield pa.RecordBatch.from_pydict({"key": digests(data, WordRuns(data, offsets)), "text": text[a:b]})

    texts = documents.filter("doc_id is not null").select("text", F.xxhash64("doc_id").alias("h"))
    return texts.transform(map_arrow, chosen, "key binary, text string").groupBy("key").agg(F.min("text").alias("text"))


def _bags(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, shingles as row, hash and count) of a run of texts."""
    for a, b, data, offsets in slices(_lower(column)):
        yield a, b, *shingles(WordRuns(data, offsets))


def similarities(keys: np.ndarray, counts: np.ndarray, row: np.ndarray, other: np.ndarray, times: np.ndarray, rows: int) -> np.ndarray:
    """Weighted Jaccard similarity of one bag (ascending keys, counts) with each of the bags (row, other, times)."""
    at = np.minimum(np.searchsorted(keys, other), len(keys) - 1)
    shared = np.bincount(row, np.where(keys[at] == other, np.minimum(counts[at], times), 0), rows)
    return shared / (np.bincount(row, times, rows) + counts.sum() - shared)


def _compared(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs of a written table a, key_a, b, key_b, on their whole texts, written."""
    both = pairs.select(F.col("key_a").alias("key"), F.col("a").alias("rep")).union(pairs.select("key_b", "b"))
    texts = _texts(written(both.distinct()), documents)
    n = pairs.groupBy("key_a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    dealt = written(pairs.join(n, "key_a").withColumn("salt", F.pmod(F.xxhash64("key_b"), F.col("n")).cast("int")))
    partner = dealt.select(F.col("key_b").alias("key"), F.col("b").alias("doc_id"), "a", F.xxhash64("key_a", "salt").alias("star"), F.lit(1).alias("role"), "key_a")
    centre = dealt.select(F.col("key_a").alias("key"), F.col("a").alias("doc_id"), "a", F.xxhash64("key_a", "salt").alias("star"), F.lit(0).alias("role"), "key_a").distinct()
    rows = partner.union(centre).join(texts, "key").drop("key").repartition("star").sortWithinPartitions("star", "key_a", "role")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = counts = None
        for batch in batches:
            head = batch.column("role").to_numpy() == 0
            bounds = np.unique(np.concatenate(([0], np.flatnonzero(head), np.flatnonzero(head) + 1, [len(batch)])))
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part = batch.slice(i, j - i)
                for a, b, row, other, times in _bags(part.column("text")):
                    if head[i]:
                        keys, counts = other, times
                    else:
                        yield pa.RecordBatch.from_pydict({"a": part.column("a")[a:b], "b": part.column("doc_id")[a:b], "similarity": similarities(keys, counts, row, other, times, b - a)})

    return written(rows.transform(map_arrow, compared, "a long, b long, similarity double"))


def _dealt(members: DataFrame) -> DataFrame:
    """members (with band, key, bytes), dealt as pairs i, j of blocks of bounded size of each band; own: the row's block."""
    n = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int")
    sizes = written(members.groupBy("band").agg(n.alias("n")))
    own = F.pmod(F.xxhash64("key"), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    return members.join(sizes, "band").withColumn("own", own).withColumn("pair", F.explode(pairs)).select(*members.columns, "own", "pair.i", "pair.j")


def _agreeing(group: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, coordinates that agree) of the pairs of different classes in a group whose signatures agree enough for the
    similarity (within five deviations), but for pairs that meet in an earlier band or in a block of their own."""
    signatures = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint32).reshape(len(group), K)
    bands, here = band_keys(signatures), group["band"].to_numpy()[0]
    at = int(np.flatnonzero(bands[0].view(np.int64) == here)[0])
    own = group["own"].to_numpy()
    _, label = np.unique(group["of"].to_numpy(), return_inverse=True)
    least = (similarity - 5 * np.sqrt(similarity * (1 - similarity) / K)) * K
    out = []
    for a in range(0, len(group), 256):
        agree = np.zeros((min(256, len(group) - a), len(group)), np.int16)
        for k in range(K):
            agree += signatures[a : a + 256, k, None] == signatures[None, :, k]
        i, j = np.nonzero((agree >= least) & (label[a : a + 256, None] != label[None, :]))
        agree, i = agree[i, j], i + a
        good = (i < j) & ~(bands[i, :at] == bands[j, :at]).any(1)
        if group["i"][0] != group["j"][0]:
            good &= own[i] != own[j]
        out.append((i[good], j[good], agree[good]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _linked_in_buckets(members: DataFrame, documents: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join classes (of) in buckets (band), enough to connect what is linked there.

    Blocks of signatures come first and leave the documents that agree enough with one of another class. Their texts
    are then compared exactly in the same blocks, the most alike first, unless links found before already join them.
    """

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "band", "i", "j"):
            i, j, _ = _agreeing(group, similarity)
            if len(i):
                yield from group.take(pa.array(np.unique(np.concatenate((i, j))))).combine_chunks().to_batches()

    keys = ["band", "i", "j"]
    schema = "band long, key binary, rep long, of long, signature binary, bytes long, own int, i int, j int"
    dealt = _dealt(members).repartition(*keys).sortWithinPartitions(*keys, "rep")
    found = written(dealt.transform(map_arrow, agreeing, schema))
    texts = _texts(written(found.select("key", "rep").distinct()), documents)
    dealt = found.join(texts, "key").repartition(*keys).sortWithinPartitions(*keys, "rep")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, *keys):
            i, j, agree = _agreeing(group, similarity)
            bags = {}
            for a, b, row, other, times in _bags(group["text"].combine_chunks()):
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                bags.update({a + r: (other[slice(*bounds[r : r + 2])], times[slice(*bounds[r : r + 2])]) for r in range(b - a)})
            ids, label, links = group["rep"].to_numpy(), group["of"].to_numpy().copy(), []
            order = np.argsort(-agree, kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                if label[x] != label[y] and similarities(*bags[x], np.zeros(len(bags[y][0]), np.int64), *bags[y], 1)[0] >= similarity:
                    links.append((ids[x], ids[y]))
                    label[label == label[y]] = label[x]
            if links:
                yield pa.RecordBatch.from_pydict({"a": [x for x, _ in links], "b": [y for _, y in links]})

    return written(dealt.transform(map_arrow, linked, "a long, b long"))


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and kept (doc_id = class_id), one row per document."""
    known = written(_signed(documents.filter("doc_id is not null")))
    copies = written(known.groupBy("key").agg(F.min("doc_id").alias("rep")))
    # only representatives meet in bands; a doc_id with several texts has one for each
    reps = known.join(copies.select("key", F.col("rep").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["key"])
    reps = written(reps.withColumnRenamed("doc_id", "rep"))
    banded = written(reps.select("key", "rep", F.explode("bands").alias("band")))
    stars = banded.groupBy("band").agg(F.min(F.struct("rep", "key")).alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = written(stars.select("band", F.col("a.rep").alias("a"), F.col("a.key").alias("key_a")))
    members = written(banded.withColumnsRenamed({"rep": "b", "key": "key_b"}).join(stars, "band").filter("key_a <> key_b"))
    compared = _compared(written(members.select("a", "key_a", "b", "key_b").distinct()), documents)
    links = compared.filter(F.col("similarity") >= similarity).select("a", "b")
    # a doc_id with several texts joins their classes
    several = known.groupBy("doc_id").agg(F.min("key").alias("x"), F.max("key").alias("y")).filter("x <> y").select("doc_id")
    several = written(known.select("doc_id", "key").join(several, "doc_id").join(copies, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    links = links.union(several)
    classes = written(components(links))
    # buckets whose members are still of several classes
    rated = members.join(classes.withColumnRenamed("node", "b"), "b", "left")
    rated = written(rated.select("band", "b", "key_b", F.coalesce("component", "b").alias("of")))
    open_ = written(rated.groupBy("band").agg(F.min("of").alias("x"), F.max("of").alias("y")).filter("x <> y").select("band"))
    left = written(rated.join(open_, "band").select("band", F.col("key_b").alias("key"), F.col("b").alias("rep"), "of"))
    left = written(left.join(reps.select("key", "signature", "bytes"), "key").select("band", "key", "rep", "of", "signature", "bytes"))
    again = _linked_in_buckets(left, documents, similarity)
    if again.limit(1).count():
        classes = written(components(links.union(again)))
    found = copies.join(classes.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("class_id"))
    placed = known.select("doc_id", "key").join(written(found), "key").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = documents.select("doc_id").join(placed, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
