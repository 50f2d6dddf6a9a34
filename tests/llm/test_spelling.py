"""Spelling variants against a plain version: all words with all words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.llm import spelling
from tidewire.llm.common import written
from tidewire.llm.textscan import SLICE_BYTES

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_words(rows):
    found = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if doc is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def are_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = {w: [v for v in words if are_near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def listed(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def made(n, letters, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(60)]
    return [(i if rng.random() < 0.95 else None, rng.choice([" ", ", ", "1", "\n"]).join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=60)) if rng.random() < 0.95 else None) for i in range(n)]


@pytest.mark.parametrize("letters", ["aB", "abÀ", "xyzé÷×"])
def test_variants(spark, letters):
    rows = made(120, letters, len(letters))
    documents = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string").withColumns({"n": F.lit("x"), "word": F.lit(1), "id": F.lit(2), "node": F.lit(3)})
    assert listed(spelling.spelling_variants(documents)) == plain_variants(plain_words([*rows, *rows[:5]]))


def test_chain_of_forms(spark):
    """Each word has twice the occurrences of the next, one letter further on."""
    words = ["a" * i + "b" * (12 - i) for i in range(9)]
    rows = [(None, " ".join([w] * (3 << i))) for i, w in enumerate(words)]
    got = listed(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_variants(plain_words(rows))
    assert got[words[0]][1] == words[-1]


def test_empty(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, ""), (3, "1 2 ab")], "doc_id long, text string")).count() == 0


def test_long_runs_and_texts(spark):
    run = "ab" * 20_000
    rows = [(i, run + ("" if i < 3 else "c")) for i in range(6)] + [(9, "hello world. " * 200_000 + "x" * (SLICE_BYTES + 77) + " é")]
    assert listed(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_variants(plain_words(rows))


def test_any_heavy_child_gives_all_pairs(spark, monkeypatch):
    """Nodes that share a hash have one heavy letter; here they all do, by their place or altogether."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(5, 8))) for _ in range(150)})
    rows = [(i, w, rng.randrange(3, 50)) for i, w in enumerate(words)]
    want = {w: x[3] for w, x in plain_variants({w: n for _, w, n in rows}).items() if x[3]}
    table = written(spark.createDataFrame(rows, "id long, word string, n long"))
    for keys in (spelling.prefix_keys, lambda p, n: np.concatenate([np.arange(k) for k in n.tolist()]).astype(np.uint64), lambda p, n: np.zeros(len(p), np.uint64)):
        monkeypatch.setattr(spelling, "prefix_keys", keys)
        places = [b.to_pydict() for b in spelling._positions(iter([pa.RecordBatch.from_pydict({"id": [r[0] for r in rows], "word": words})]))]
        monkeypatch.setattr(spelling, "map_arrow", lambda df, f, schema, real=spelling.map_arrow, p=places: spark.createDataFrame([x for b in p for x in zip(b["node"], b["letter"], b["id"], b["place"])], schema) if f is spelling._positions else real(df, f, schema))
        assert {r["word"]: r["n_near"] for r in spelling.near_words(table).collect()} == want
        monkeypatch.undo()


def test_checksums():
    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 50_000).astype(np.uint8)
    size = np.concatenate((rng.integers(0, 300, 200), [0, 64, 65, 63, 1]))
    ends = np.cumsum(size)
    before = rng.integers(0, 1 << 32, len(size)).astype(np.uint32)
    got = spelling.crc32_of(data, ends - size, ends, before)
    assert got.tolist() == [zlib.crc32(data[e - s : e].tobytes(), int(b)) for s, e, b in zip(size.tolist(), ends.tolist(), before.tolist())]
