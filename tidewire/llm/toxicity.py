"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences; only documents carry labels. A sentence that has features scores p = sigmoid(b + sum
of their weights), any other 0; the document scores 1 - (1 - leak) * product of (1 - p) over its sentences (noisy-or),
and b, the leak and the weights are trained from document labels through that product. The leak is a document's, not a
sentence's, so that sentences without evidence never add up, however many. The sentences that make a document toxic are
those with a high p.

Features are a sentence's lower-case words and the first four and five bytes of each, by hash. Kept are all those whose
documents are toxic too often for chance, given how many features there are.

The fit uses at most SAMPLE labelled documents of each label (those with the smallest hash of doc_id), their texts whole;
scoring covers every whole text, a long one in parts that end where a sentence does. Null and empty texts count as one
empty sentence. Repeated rows score alike, and doc_id, lang, source and labels are no features. Without labelled rows
every score is low.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.llm.common import carried, map_arrow, written
from tidewire.llm.textscan import SLICE_BYTES, KeyTable, _runs, byte_hashes, eights, slices

#: Labelled documents of each label that the fit uses at most.
SAMPLE = 3000
#: Parts in which the sampled documents are read.
PARTS = 12
#: Where b and the leak's logit start; they only fall, lest the many sentences of a long clean document that have weak
#: features add up to a toxic one.
BIAS, LEAK = -11.0, -5.0

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_STOPS = np.zeros(256, bool)
_STOPS[list(b".!?\n")] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sentence of each key, sentence bounds as byte positions, first sentence of each row and the end).

    data: lower-case UTF-8. A sentence ends after . ! ? or a line end; each row has at least one.
    """
    n = len(data)
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    starts, ends = _runs(_LETTERS, data, offsets)
    begins = row[:-1].copy()
    begins[1:] |= _STOPS[data[:-1]]
    bounds = np.sort(np.concatenate((np.flatnonzero(begins), offsets[:-1][np.diff(offsets) == 0])))  # an empty row has one too
    sentence = np.searchsorted(bounds, starts, "right") - 1
    view = eights(data)
    keys, owners = [byte_hashes(data, starts, ends, view=view)], [sentence]
    for size in (4, 5):
        long = ends - starts > size
        keys.append(byte_hashes(data, starts[long], starts[long] + size, size, view))
        owners.append(sentence[long])
    per_row = np.maximum(np.diff(np.searchsorted(np.flatnonzero(begins), offsets)), 1)
    return np.concatenate(keys), np.concatenate(owners), np.append(bounds, n), np.concatenate(([0], np.cumsum(per_row)))


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first byte): the slice itself, or the parts of one long row, which end where a sentence does."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        yield data, offsets, 0
        return
    a = 0
    while a < len(data):
        b = a + SLICE_BYTES
        while b < len(data):
            stops = np.flatnonzero(_STOPS[data[b - 1 : b - 1 + SLICE_BYTES]])
            b += int(stops[0]) if len(stops) else SLICE_BYTES
            if len(stops):
                break
        b = min(b, len(data))
        yield data[a:b], np.array([0, b - a]), a
        a = b


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    leak: float

    def table(self) -> KeyTable:
        table = KeyTable()
        table.add(self.keys)
        return table

    def sentences(self, data: np.ndarray, offsets: np.ndarray, table: KeyTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(p of each sentence, their bounds, first sentence of each row and the end)."""
        keys, owner, bounds, rows = _features(data, offsets)
        at = table.lookup(keys)
        hit = at >= 0
        z = self.bias + np.bincount(owner[hit], self.weights[at[hit]], len(bounds) - 1)
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        p[np.bincount(owner[hit], minlength=len(p)) == 0] = 0.0
        return p, bounds, rows

    def scores(self, data: np.ndarray, offsets: np.ndarray, table: KeyTable) -> tuple[np.ndarray, ...]:
        """(score of each row, number of its sentences, byte bounds of the first of those with the highest p)."""
        log, n, top = np.full(len(offsets) - 1, np.log1p(-self.leak)), np.zeros(len(offsets) - 1, np.int64), np.full(len(offsets) - 1, -1.0)
        start, end = offsets[:-1].copy(), offsets[:-1].copy()
        for part, at, first in _parts(data, offsets):
            p, bounds, rows = self.sentences(part, at, table)
            sums = np.concatenate(([0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))))
            log += sums[rows[1:]] - sums[rows[:-1]]
            n += np.diff(rows)
            worst = np.array([r + int(np.argmax(p[r:e])) for r, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)], np.int64)
            better = p[worst] > top
            top[better], start[better], end[better] = p[worst][better], first + bounds[worst][better], first + bounds[worst + 1][better]
        return np.clip(-np.expm1(log), 0, 1), n, start, end


def _evidence(d1: np.ndarray, d0: np.ndarray, prior: float) -> np.ndarray:
    """How little chance explains that d1 of the d1 + d0 documents with a feature are toxic: minus the logarithm of
    Chernoff's bound; 0 where no more are toxic than elsewhere."""
    d = d1 + d0
    share = d1 / np.maximum(d, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(d1 > 0, share * np.log(share / prior), 0) + np.where(d0 > 0, (1 - share) * np.log((1 - share) / (1 - prior)), 0)
    return np.where(share > prior, d * kl, 0.0)


def _prune(keys: np.ndarray, d1: np.ndarray, d0: np.ndarray, n1: int, n0: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(kept keys in order, weights to start from), given in how many documents of each label each key is."""
    evidence = _evidence(d1, d0, n1 / (n1 + n0))
    kept = np.flatnonzero(evidence >= np.log(max(features, 1)) - 1)
    kept = kept[np.argsort(keys[kept])]
    return keys[kept], np.log((d1[kept] + 0.5) / n1 / ((d0[kept] + 0.5) / n0)) / 2


def _learn(keys: np.ndarray, start: np.ndarray, labels: np.ndarray, doc: np.ndarray, sentence: np.ndarray, feature: np.ndarray, rounds: int = 600, l2: float = 1e-3) -> Model:
    """Adam on the mean log loss of the bags. labels of the documents; document, sentence and feature of each occurrence."""
    used, sentence = np.unique(doc * (1 << 32) + sentence, return_inverse=True)
    doc = used >> 32
    theta = np.concatenate((start, [BIAS, LEAK]))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        leak = 1 / (1 + np.exp(-theta[-1]))
        p = 1 / (1 + np.exp(-np.clip(theta[-2] + np.bincount(sentence, theta[feature], len(used)), -60, 60)))
        s = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(labels)) + np.log1p(-leak)
        pull = np.where(labels == 1, -np.exp(s) / np.maximum(-np.expm1(s), 1e-9), 1.0) / len(labels)
        dz = pull[doc] * p
        weights = np.bincount(feature, dz[sentence], len(start)) + l2 * theta[:-2] / max(len(start), 1)
        grad = np.concatenate((weights, [dz.sum(), pull.sum() * leak]))
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        theta -= 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        theta[-2:] = np.minimum(theta[-2:], [BIAS, LEAK])
    return Model(keys, theta[:-2], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def _slices_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first document, end document, key, document and sentence of each feature), slice by slice; a long document comes
    in several parts."""
    for a, b, data, offsets in slices(pc.utf8_lower(texts)):
        before = 0
        for part, at, _ in _parts(data, offsets):
            keys, owner, _, rows = _features(part, at)
            doc = np.searchsorted(rows, owner, "right") - 1
            yield a, b, keys, a + doc, owner - rows[doc] + before
            before += int(rows[-1])


def _key_counts(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, toxic documents, other documents that have them), of each slice one after another."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    part_keys: list[np.ndarray] = []
    last = -1

    def add(keys: np.ndarray, doc: np.ndarray) -> None:
        order = np.lexsort((doc, keys))
        keys, doc = keys[order], doc[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])))[: len(keys)]
        distinct, at = np.unique(keys[new], return_inverse=True)
        d1 = np.bincount(at, toxic[doc[new]], len(distinct)).astype(np.int64)
        out.append((distinct, d1, np.bincount(at, minlength=len(distinct)) - d1))

    def finish() -> None:
        if part_keys:
            keys = np.unique(np.concatenate(part_keys))
            part_keys.clear()
            add(keys, np.full(len(keys), last))

    for a, b, keys, doc, _ in _slices_of(texts):
        if last != a:
            finish()
        last = a
        if b - a > 1:
            add(keys, doc)
        else:  # maybe one of several parts of one document, which counts once
            part_keys.append(np.unique(keys))
    finish()
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2


def _occurrences(texts: pa.Array, table: KeyTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, sentence and feature of each occurrence of a kept key)."""
    found = [(np.zeros(0, np.int64),) * 3]
    for _, _, keys, doc, sentence in _slices_of(texts):
        at = table.lookup(keys)
        hit = at >= 0
        found.append((doc[hit], sentence[hit], at[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _numbered(keys: np.ndarray) -> KeyTable:
    table = KeyTable()
    table.add(keys)
    return table


def _without_labels(labels: np.ndarray) -> Model | None:
    if len(labels) and labels.min() != labels.max():
        return None
    return Model(np.zeros(0, np.uint64), np.zeros(0), BIAS, 0.5 if len(labels) and labels[0] == 1 else 1 / (1 + np.exp(-LEAK)))


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """From few texts, at one place."""
    if (model := _without_labels(labels)) is not None:
        return model
    column = pa.array(texts, pa.large_string())
    keys, d1, d0 = _key_counts(column, labels == 1)
    distinct, at = np.unique(keys, return_inverse=True)
    d1, d0 = np.bincount(at, d1, len(distinct)), np.bincount(at, d0, len(distinct))
    keys, start = _prune(distinct, d1, d0, int((labels == 1).sum()), int((labels == 0).sum()), int((d1 + d0 > 1).sum()))
    return _learn(keys, start, labels, *_occurrences(column, _numbered(keys)))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """labels: doc_id, toxic (0 or 1; others are left out; of several, the largest holds).

    The sampled documents stay on the executors: they count in how many documents each feature is, and, once the
    features are chosen, send the occurrences of these to the driver, which only runs the descent.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        ids = part if ids is None else ids.union(part)
    chosen = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    chosen = written(chosen.repartition(PARTS, "doc_id"))
    per_label = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = per_label.get(1, 0), per_label.get(0, 0)
    if (model := _without_labels(np.array([1] * bool(n1) + [0] * bool(n0)))) is not None:
        return model

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, d1, d0 = _key_counts(batch.column("text"), batch.column("toxic").to_numpy() == 1)
            yield pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "d1": d1, "d0": d0})

    counts = chosen.transform(map_arrow, counted, "key long, d1 long, d0 long").groupBy("key").agg(F.sum("d1").alias("d1"), F.sum("d0").alias("d0"))
    counts = written(counts.filter("d1 + d0 > 1"))
    features, prior = counts.count(), n1 / (n1 + n0)
    d, share = F.col("d1") + F.col("d0"), F.col("d1") / (F.col("d1") + F.col("d0"))
    clean = F.when(F.col("d0") > 0, (1 - share) * F.log((1 - share) / (1 - prior))).otherwise(0.0)
    toxic = F.when(F.col("d1") > 0, share * F.log(F.when(F.col("d1") > 0, share).otherwise(1.0) / prior)).otherwise(0.0)
    # a little less than _prune asks for, which decides
    top = counts.filter(share > prior).withColumn("e", d * (toxic + clean)).filter(F.col("e") >= float(np.log(max(features, 1)) - 1.001)).toArrow()
    keys, start = _prune(top["key"].to_numpy().view(np.uint64), top["d1"].to_numpy(), top["d0"].to_numpy(), n1, n0, features)

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _numbered(keys)
        for batch in batches:
            doc, sentence, feature = _occurrences(batch.column("text"), table)
            order = np.argsort(doc, kind="stable")
            bounds = pa.array(np.searchsorted(doc[order], np.arange(len(batch) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x[order].astype(np.int32))) for x in (sentence, feature)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "sentence": lists[0], "feature": lists[1]})

    got = chosen.transform(map_arrow, occurring, "doc_id long, toxic int, sentence array<int>, feature array<int>").toArrow().sort_by("doc_id")
    doc = np.repeat(np.arange(len(got)), pc.list_value_length(got["sentence"]).to_numpy())
    flat = [pc.list_flatten(got[c]).to_numpy().astype(np.int64) for c in ("sentence", "feature")]
    return _learn(keys, start, got["toxic"].to_numpy(), doc, *flat)


def score_documents(documents: DataFrame, model: Model, others: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, n_sentences, worst_start and worst_end (characters of the worst sentence in the lower-cased text)
    and, of the columns named in others, text and the rest as a struct named documents."""
    rows = documents.select("doc_id", "text", carried(documents, others))
    schema = StructType([rows.schema["doc_id"]]).add("score", "double").add("n_sentences", "long").add("worst_start", "long").add("worst_end", "long")
    for name in ("text", "documents") if others else ():
        schema.add(rows.schema[name])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            for a, b, data, offsets in slices(pc.utf8_lower(batch.column("text"))):
                score, n, start, end = model.scores(data, offsets, table)
                chars = [[int(((data[f:x] & 0xC0) != 0x80).sum()) for f, x in zip(offsets[:-1].tolist(), to.tolist(), strict=True)] for to in (start, end)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[a:b], "score": score, "n_sentences": n, "worst_start": chars[0], "worst_end": chars[1], "text": batch.column("text")[a:b], "documents": batch.column("documents")[a:b]})

    return rows.transform(map_arrow, scored, schema)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0
