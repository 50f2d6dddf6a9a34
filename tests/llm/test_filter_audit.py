"""The filter audit against a plain version: documents one by one, orders one by one."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewire.llm import textscan
from tidewire.llm.filter_audit import _WORDS, audit, class_counts, distinct_words, failures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_failures(rows):
    """A set of letters for each (doc_id, text)."""
    out = []
    for doc, text in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}
        fails["E"] = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t in rows)
        out.append({k for k, v in fails.items() if v})
    return out


def plain_audit(rows, labels):
    """rows: (doc_id, text, part)"""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    fails = plain_failures([r[:2] for r in rows])
    out = {}
    for part in {r[2] or "" for r in rows}:
        here = [(r[0], f) for r, f in zip(rows, fails) if (r[2] or "") == part]
        removals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = here
            for step, letter in enumerate(order):
                removed = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                removals[letter] += len(removed)
                redundant = sum(letter in f for _, f in here) - len(removed)
                alone = sum(f == {letter} for _, f in here)
                out[part, "".join(order), step + 1] = [len(left), len(removed), redundant, alone, sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(removals[order[step - 1]])
    return out


def made(n, seed):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "δέλτα", "é", "x#", "y|z", " ", "fin."] + [f"w{i}" for i in range(80)]
    texts = [rng.choice([" ", "\t", "\n\x0b", "  "]).join(rng.choices(vocabulary[: rng.choice([9, 89])], k=rng.choice([0, 3, 49, 50, 51, 120]))) for _ in range(n)]
    rows = [(rng.randrange(n) if rng.random() > 0.05 else None, rng.choice(texts[: n // 3] + texts[-3:]) if rng.random() < 0.9 else None, rng.choice(["a", "b", None, ""])) for _ in range(n)]
    return rows + rows[:3]


def listed(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit(spark):
    rows = made(150, 1)
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"fails": F.lit("x"), "digest": F.lit(1), "part": F.lit(2), "first": F.lit(3)})
    got = audit(documents, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.count() == 3 * 600
    assert listed(got) == plain_audit(rows, labels)


def test_empty_and_all_null(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit(none, labels).count() == 0
    one = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    assert listed(audit(one, labels)) == plain_audit([(None, None, None)], [])


def test_long_text(spark):
    text = "lorem ipsum " * 200_000 + "x" * 3_000_000 + " " + "x" * 3_000_000 + "y"
    rows = [(1, text), (2, text), (0, text + "z")]
    got = failures(spark.createDataFrame([(*r, "a") for r in rows], "doc_id long, text string, source string")).collect()
    assert {r.doc_id: {c for k, c in enumerate("ABCDE") if r.fails >> k & 1} for r in got} == {d: f for (d, _), f in zip(rows, plain_failures(rows))}


def arrays(texts):
    for _, _, data, offsets in textscan.slices(pa.array(texts), 1 << 30):
        return data, offsets, *textscan.words(data, offsets)


def test_words_of_equal_hash_are_compared():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "b", "ab", "ba", "c" * 300, "c" * 299 + "d", "é"], k=rng.randrange(12))) for _ in range(40)]
    data, offsets, starts, ends, rows = arrays(texts)
    want = [len(set(WORD.findall(t))) for t in texts]
    for hashes in (textscan.byte_hashes, lambda d, s, e, view: np.zeros(len(s), np.uint64), lambda d, s, e, view: (e - s).astype(np.uint64)):
        assert distinct_words(data, starts, ends, rows, hashes).tolist() == want


def test_many_words_of_one_text():
    rng = random.Random(3)
    texts = ["", " ".join(str(rng.randrange(300_000)) for _ in range(2 * _WORDS + 5)), "a b a"]
    data, offsets, starts, ends, rows = arrays(texts)
    assert distinct_words(data, starts, ends, rows).tolist() == [0, len(set(texts[1].split())), 2]


def test_classes_across_parts():
    texts = ["A#é" * 700_000, "", "ÀB|" * 400_000, "x"]
    data, offsets, *_ = arrays(texts)
    want = [[sum("A" <= c <= "Z" for c in t) for t in texts], [sum(c in "#$%&*|" for c in t) for t in texts], [len(t) for t in texts]]
    assert class_counts(data, offsets).tolist() == want
