"""Operator 10: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. ITQ: on a bounded sample of unit vectors, principal axes and a rotation are learned so that the signs of the rotated
   coordinates are balanced binary codes of little quantisation error. Every vector gets a code of at most 64 bits.
2. Codes are cut into parts, a table each; vectors of one label and dimension meet in a table's bucket where the part is
   equal or differs in one bit: at every size alike there are four wide parts, so that buckets stay small, and every code
   is also looked up with each single bit of the part turned over. Codes that differ in seven bits or fewer always meet,
   and most others do.
3. In buckets, pairs within RADIUS bits of Hamming distance are ranked again by the cosine of the original vectors in
   double precision. Large buckets are dealt as pairs of blocks of bounded size; links are counted and joined to trees
   inside the task, never listed pair by pair. A pair that meets several times counts in the first table.

Equal vectors of a label are one representative with a count. Vectors that are null, zero, of no label, or hold null or
non-finite components link with nothing; vectors of different dimension don't link. Codes look at the first WIDTH
components. Rows without vec_id come back as their own class with null component_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.blocks import groups, matrix, padded, usable
from tidewire.llm.common import components, map_arrow, written

COSINE, SAMPLE, BLOCK, WIDTH = 0.98, 6000, 768, 4096
#: Bits in which codes of linked vectors may differ: 0.98 is an angle of 11.5 degrees, 4.1 of 64 bits on average.
RADIUS = 18
#: Parts of a code, and bits of a part that may be turned over.
TABLES, PROBES = 4, 1


def fit_itq(sample: np.ndarray, rounds: int = 40, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to at most 64 coordinates): principal axes times the rotation that ITQ finds."""
    mean = sample.mean(0)
    centred = sample - mean
    bits = min(64, sample.shape[1])
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1].T
    v = centred @ axes[:bits].T
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
        rotation = (u @ w).T
    return mean, axes[:bits].T @ rotation


def codes(unit: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    bits = (unit - model[0]) @ model[1] >= 0
    return np.packbits(np.pad(bits, ((0, 0), (0, 64 - bits.shape[1]))), axis=1, bitorder="little").view(np.int64).reshape(-1)


def part_masks(bits: int, tables: int) -> np.ndarray:
    """The bits of each table's part."""
    return np.array([sum(1 << int(b) for b in part) for part in np.array_split(np.arange(bits), tables)], np.uint64)


def _links(table: int, masks: np.ndarray, probes: int, a: np.ndarray, b: np.ndarray, code_a: np.ndarray, code_b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and b of the pairs of unit vectors that are linked and meet in no earlier table."""
    out = []
    for s in range(0, len(a), 256):
        apart = code_a[s : s + 256, None] ^ code_b[None, :]
        i, j = np.nonzero(np.bitwise_count(apart) <= RADIUS)
        apart = apart[i, j]
        first = np.ones(len(i), bool)
        for t in range(table):
            first &= np.bitwise_count(apart & masks[t]) > probes
        i, j = i[first] + s, j[first]
        for c in range(0, len(i), 1 << 14):
            x, y = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
            near = np.einsum("ij,ij->i", a[x], b[y]) >= cosine
            out.append((x[near], y[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each can reach by the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicate_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    some = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists("embedding", lambda x: x != 0)
    keys = [F.when(some, F.xxhash64("label", "embedding")).alias("k"), F.when(some, F.xxhash64(F.lit(11), "embedding", "label")).alias("k2")]
    base = embeddings.select("vec_id", "label", "embedding", *keys)
    usual = base.filter("k is not null")
    reps = usual.groupBy("k", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()))
    about = reps.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    if about.n:
        width = min(about.width, WIDTH)
        sample = reps.select(padded("embedding", width).alias("embedding"), F.xxhash64("k").alias("h")).orderBy("h").limit(SAMPLE).toArrow()
        model = fit_itq(_unit(matrix(sample["embedding"].combine_chunks())))
        found = _found(reps, model, width, TABLES, PROBES, cosine)
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
        known = reps.select("k", "k2", "node", "rep", "copies").join(links, "node", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        known = reps.select("k", "k2", "rep", "copies", F.lit(0).cast("long").alias("links"), F.col("rep").alias("component"))
    known = written(known.select("k", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c")))
    out = base.select("vec_id", "k", "k2").join(known, ["k", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of norm 1; a row of zeros stays. Scaled first, so that no square overflows."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _found(reps: DataFrame, model: tuple[np.ndarray, np.ndarray], width: int, tables: int, probes: int, cosine: float) -> DataFrame:
    """node, rep, links (vectors of other representatives linked to it), root (the rep of one that it reaches), for parts
    of each bucket."""
    masks = part_masks(model[1].shape[1], tables)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                c = codes(_unit(matrix(batch.column("first"))), model)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(c)], ["node", "code"])

    code = reps.select("node", padded("embedding", width).alias("first")).transform(map_arrow, coded, "node long, code long")
    with_codes = written(reps.select("node", "rep", "copies", "label", "embedding", F.size("embedding").alias("d")).join(code, "node"))
    # where a code is looked up: each table's part, and with probes the part with each of its bits turned over

    def looked_up(t: int, mask: int):
        flips = [0] + ([1 << b for b in range(64) if mask >> b & 1] if probes else [])
        part = F.col("code").bitwiseAND(F.lit(_signed(mask)))
        return F.transform(F.array(*[F.lit(_signed(f)) for f in flips]), lambda f: F.struct(F.lit(t).alias("t"), part.bitwiseXOR(f).alias("part"), (f == 0).alias("home")))

    places = [looked_up(t, mask) for t, mask in enumerate(masks.tolist())]
    bucket = F.inline(F.concat(*places))
    listed = with_codes.select("label", "d", bucket)
    sizes = listed.groupBy("t", "label", "d", "part").agg(F.count("*").alias("count"), F.count_if("home").alias("homes"))
    sizes = written(sizes.filter("count > 1 and homes > 0").withColumn("n", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count", "homes"))
    rows = with_codes.select("node", "rep", "copies", "label", "d", "embedding", "code", bucket).join(sizes, ["t", "label", "d", "part"])
    # the row's block, and the pairs of blocks that it is part of
    own = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.least(i, F.col("own")).alias("i"), F.greatest(i, F.col("own")).alias("j")))
    dealt = rows.withColumn("own", own).withColumn("pair", F.explode(pairs))
    dealt = dealt.withColumn("key", F.xxhash64("t", "label", "d", "part", "pair.i", "pair.j")).withColumn("second", (F.col("own") != F.col("pair.i")).cast("int"))
    dealt = dealt.select("key", "t", "part", "d", "node", "rep", "copies", "embedding", "code", "home", "second", F.expr("pair.i = pair.j").alias("same"))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "t", "part", "d", "node")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "key", "t", "part", "d"):
            x = _unit(matrix(group["embedding"].combine_chunks()))
            t, home = group["t"][0].as_py(), group["home"].to_numpy()
            code = group["code"].to_numpy().view(np.uint64)
            side, node, rep, copies = group["second"].to_numpy(), group["node"].to_numpy(), group["rep"].to_numpy(), group["copies"].to_numpy()
            same = group["same"][0].as_py()
            left, right = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
            i, j = _links(t, masks, probes, x[left], x[right], code[left], code[right], cosine)
            i, j = left[i], right[j]
            # of the buckets of a table in which a pair meets, the one that is home to the smaller node counts
            low = np.where(node[i] < node[j], i, j)
            once = home[low] & ((i < j) if same else (i != j))
            i, j = i[once], j[once]
            if len(i):
                links = np.bincount(i, copies[j], len(rep)) + np.bincount(j, copies[i], len(rep))
                root, has = roots(len(rep), i, j), np.flatnonzero(links)
                yield pa.RecordBatch.from_pydict({"node": node[has], "rep": rep[has], "links": links[has].astype(np.int64), "root": rep[root[has]]})

    return written(dealt.transform(map_arrow, compared, "node long, rep long, links long, root long"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask
