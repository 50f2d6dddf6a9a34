"""Operator 11: spelling variants: words that are one inserted, deleted or replaced letter apart, and their forms.

Tasks find the runs of letters (A-Z, a-z and U+00C0 to U+00FF) in the Arrow buffers, lower-case A-Z and make errors: where
97 divides the crc32 of `<doc_id>:<run>`, the run loses a letter. Distinct results are counted before they leave a task.

Pairs of near words come from an errata trie, whose parts are tables:

- A node is a prefix of a word, known by a 64-bit hash; a node's heavy child is the one with most words below, the others
  are light. Heavy paths follow heavy children, so a word leaves them at most log2(words) times.
- Small subtrees are merged into large ones: each word is put, for each light edge on its way, into the errata tree of the
  edge's node, with that letter skipped or replaced. Skipped: the word without the letter. Replaced: by the heavy letter
  (where it meets the heavy subtree), or by a wildcard (where it meets the other light ones). A heavy letter is skipped
  from the other side: the light word with the heavy letter put in. Beside these, each word loses its last letter.
- Terminals that coincide are found by hash joins of whole words. A wildcard's terminal holds at most one word for each
  letter; each of these words learns how many the others are and which is the best of them, without pairs.

Any choice of one heavy letter for a node finds all pairs, so nodes whose hashes agree cost time but no results.

A word's form is its near word of largest n (the smallest of equal ones), if that n is at least twice its own; roots
come from doubling the pointers to forms. Null texts have no words; rows without doc_id lose no letters; rows that repeat
a doc_id count each. A run of any length is a word (its prefixes are hashes, a row each). An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import map_arrow, text_of, written
from tidewire.llm.textscan import SLICE_BYTES, U64, mix, ragged, slices

LEAST_POINTS, LEAST_N, ERRORS = 5, 3, 97
#: Distinct words that a task holds before it hands their counts on.
_HELD = 1 << 18
#: Runs of more bytes have their checksums taken one by one.
_LONG = 64

_ASCII = np.zeros(256, bool)
_ASCII[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
#: The first byte of U+00C0 to U+00FF in UTF-8.
_LATIN = 0xC3

_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1)


def _letters(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters."""
    latin = data == _LATIN
    out = _ASCII[data] | latin
    out[1:] |= latin[:-1]
    return out


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row numbers, bytes, offsets); a long row comes in parts that end where no letter is."""
    for a, b, data, offsets in slices(column):
        if b - a > 1 or len(data) <= SLICE_BYTES:
            yield np.arange(a, b), data, offsets
            continue
        at = 0
        while at < len(data):
            end = min(at + SLICE_BYTES, len(data))
            while end < len(data):
                free = np.flatnonzero(~_letters(data[end - 1 : end + SLICE_BYTES])[1:])
                end = min(end + (int(free[0]) if len(free) else SLICE_BYTES), len(data))
                if len(free):
                    break
            yield np.array([a]), data[at:end], np.array([0, end - at])
            at = end


def crc32_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each run of bytes, continued from that of what stands before it."""
    out, size = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF), ends - starts
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -_LONG))
    live = order[long:]
    k, sizes = 0, -size[live]
    while len(live := live[: int(np.searchsorted(sizes[: len(live)], -k))]):
        out[live] = _CRC[(out[live] ^ data[starts[live] + k]) & np.uint32(0xFF)] ^ (out[live] >> np.uint32(8))
        k += 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return out


def _words_of(data: np.ndarray, offsets: np.ndarray, doc_ids: list) -> pa.Array:
    """The words of at least LEAST_POINTS letters, with the errors."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _letters(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (edge[:-1] | ~inside[:-2]))
    ends = np.flatnonzero(inside[1:-1] & (edge[1:] | ~inside[2:])) + 1
    latin = np.concatenate(([0], np.cumsum(data == _LATIN)))
    points = ends - starts - (latin[ends] - latin[starts])
    long = points >= LEAST_POINTS
    starts, ends, points = starts[long], ends[long], points[long]
    lowered = data + ((data >= ord("A")) & (data <= ord("Z"))).astype(np.uint8) * np.uint8(32)
    row = np.searchsorted(offsets, starts, "right") - 1
    before = np.array([zlib.crc32(b"%d:" % d) if d is not None else 0 for d in doc_ids], np.uint32)
    known = np.array([d is not None for d in doc_ids], bool)
    digests = crc32_of(lowered, starts, ends, before[row])
    wrong = (digests % ERRORS == 0) & known[row]
    cut = []
    for s, e, n, h in zip(starts[wrong].tolist(), ends[wrong].tolist(), points[wrong].tolist(), digests[wrong].tolist(), strict=True):
        if n > LEAST_POINTS:
            word = lowered[s:e].tobytes().decode()
            cut.append(word[: h % n] + word[h % n + 1 :])
    starts, size = starts[~wrong], (ends - starts)[~wrong]
    whole = lowered[ragged(starts, size)]
    places = np.concatenate(([0], np.cumsum(size)))
    right = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(places), pa.py_buffer(whole))
    return pa.concat_arrays([right, pa.array(cut, pa.large_string())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for rows, data, offsets in _parts(batch.column("text")):
            counts = pc.value_counts(_words_of(data, offsets, [doc_ids[i] for i in rows.tolist()]))
            held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
            n += len(counts)
            if n >= _HELD:
                held = [summed()]
                n = len(held[0])
                if n >= _HELD // 2:
                    yield from held[0].combine_chunks().to_batches(1 << 16)
                    held, n = [], 0
    if held:
        yield from summed().combine_chunks().to_batches(1 << 16)


def count_words(documents: DataFrame) -> DataFrame:
    """word and n, of words that occur at least LEAST_N times."""
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    counted = map_arrow(read, _counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_N)


#: An odd factor for polynomial hashes modulo 2**64.
_FACTOR = 0x9E3779B97F4A7C15


def prefix_keys(points: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each letter of words that follow each other, the hash of what stands before it in its word."""
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(points)) - np.repeat(first, lengths)
    powers = np.cumprod(np.concatenate(([U64(1)], np.full(int(lengths.max(initial=1)) - 1, U64(_FACTOR)))))
    sums = np.concatenate(([U64(0)], np.cumsum((points.astype(U64) + U64(1)) * powers[place])))
    before = sums[:-1] - np.repeat(sums[first], lengths)
    return mix(before + mix(place.astype(U64)))


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        ids = batch.column("id").to_numpy()
        a = 0
        while a < len(words):
            b, size = a + 1, len(words[a])
            while b < len(words) and size < 1 << 16:
                size += len(words[b])
                b += 1
            lengths = np.array([len(w) for w in words[a:b]], np.int64)
            points = np.frombuffer("".join(words[a:b]).encode("utf-32-le"), "<u4")
            first = np.cumsum(lengths) - lengths
            place = np.arange(len(points)) - np.repeat(first, lengths)
            yield pa.RecordBatch.from_pydict({"node": prefix_keys(points, lengths).view(np.int64), "letter": points.astype(np.int32), "id": np.repeat(ids[a:b], lengths), "place": place.astype(np.int32)})
            a = b


def _errata(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a word is looked up as (wild false), and where it stands under wildcards (wild true)."""
    for batch in batches:
        out: dict[str, list] = {"word": [], "n": [], "entry": [], "wild": []}
        size = 0
        for word, n, edges in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "edges")), strict=True):
            entries = {word[:-1]}
            wild = []
            for edge in edges or ():
                i, heavy = edge["place"], chr(edge["heavy"])
                entries |= {word[:i] + word[i + 1 :], word[:i] + heavy + word[i + 1 :], word[:i] + heavy + word[i:]}
                wild.append(f"{word[:i]}*{word[i + 1 :]}")
            for entry, is_wild in [*((e, False) for e in entries), *((e, True) for e in wild)]:
                out["word"].append(word)
                out["n"].append(n)
                out["entry"].append(entry)
                out["wild"].append(is_wild)
                size += len(word) + len(entry)
            if size >= SLICE_BYTES:
                yield pa.RecordBatch.from_pydict(out)
                out, size = {k: [] for k in out}, 0
        yield pa.RecordBatch.from_pydict({k: pa.array(v, {"n": pa.int64(), "wild": pa.bool_()}.get(k, pa.string())) for k, v in out.items()})


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near and best (struct of -n and word of the best near word), for words that have near words.

    words: a written table of id, word, n; ids and words are distinct.
    """
    places = written(map_arrow(words.select("id", "word"), _positions, "node long, letter int, id long, place int"))
    below = places.groupBy("node", "letter").agg(F.count("*").alias("size"))
    nodes = below.groupBy("node").agg(F.max(F.struct("size", "letter")).getField("letter").alias("heavy"), F.count("*").alias("children"))
    # both sides are written tables: the nodes of short prefixes have many words, and their rows can be split
    nodes = written(nodes.filter("children > 1").select("node", "heavy"))
    light = places.join(nodes, "node").filter("letter <> heavy")
    edges = light.groupBy("id").agg(F.collect_list(F.struct("place", "heavy")).alias("edges"))  # log2(words) at most
    errata = written(map_arrow(words.join(edges, "id", "left").select("word", "n", "edges"), _errata, "word string, n long, entry string, wild boolean"))

    found = errata.filter("not wild").join(words.select(F.col("word").alias("entry"), F.col("n").alias("entry_n")), "entry")
    ways = F.array(F.struct("word", F.col("entry").alias("near"), F.col("entry_n").alias("near_n")), F.struct(F.col("entry").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    pairs = found.select(F.explode(ways).alias("w")).select("w.*").distinct()  # both words may find each other
    by_pair = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))

    one = F.struct((-F.col("n")).alias("less"), F.col("word").alias("near"))
    terminals = errata.filter("wild").groupBy("entry").agg(F.collect_list(one).alias("here")).filter(F.size("here") > 1)  # one for each letter at most
    each = terminals.select(F.explode("here").alias("own"), "here")
    by_terminal = each.select(F.col("own.near").alias("word"), (F.size("here") - 1).cast("long").alias("n_near"), F.array_min(F.filter("here", lambda x: x["near"] != F.col("own.near"))).alias("best"))
    return by_pair.union(by_terminal).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, for a written table of word and form whose forms lead to an end: pointers are doubled."""
    ends = forms.join(forms.select(F.col("word").alias("form"), F.lit(False).alias("last")), "form", "left")
    now = written(ends.select("word", F.col("form").alias("root"), F.coalesce("last", F.lit(True)).alias("last")))
    while now.filter("not last").limit(1).count():
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("last").alias("is_last"))
        moved = now.filter("not last").join(ahead, "root").select("word", F.col("next").alias("root"), F.col("is_last").alias("last"))
        now = written(now.filter("last").union(moved))
    return now.select("word", "root")


def spelling_variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of LEAST_POINTS letters and LEAST_N occurrences at least."""
    words = written(count_words(documents).withColumn("id", F.monotonically_increasing_id()))
    near = written(words.select("word", "n").join(near_words(words), "word", "left"))
    enough = -F.col("best.less") >= 2 * F.col("n")
    judged = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))
    found = roots(written(judged.filter("form is not null").select("word", "form")))
    return judged.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
