"""Toxicity against a plain version: features, their choice, the descent and the scores by loops; held-out figures."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from tidewire.llm import queries as Q
from tidewire.llm import toxicity as T
from tidewire.llm.common import table
from tidewire.llm.textscan import byte_hashes


def key_of(feature):
    size, run = feature
    return int(byte_hashes(np.frombuffer(run, np.uint8), np.array([0]), np.array([len(run)]), size)[0])


def plain_sentences(text):
    """The features of each sentence: words, and the first four and five bytes of longer ones."""
    out = []
    for sentence in re.split(rb"(?<=[.!?\n])", (text or "").lower().encode()):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
        out.append([f for w in words for f in [(0, w), *[(n, w[:n]) for n in (4, 5) if len(w) > n]]])
    return out


def plain_fit(texts, labels, rounds=600):
    """(weight of each kept feature, bias, leak)"""
    docs = [plain_sentences(t) for t in texts]
    having = {}
    for doc, label in zip(docs, labels):
        for f in {f for s in doc for f in s}:
            having.setdefault(f, [0, 0])[label] += 1
    n1, n0 = sum(labels), len(labels) - sum(labels)
    prior, several = n1 / (n1 + n0), sum(sum(x) > 1 for x in having.values())
    theta = {}
    for f, (d0, d1) in having.items():
        share = d1 / (d1 + d0)
        if share > prior:
            evidence = (d1 + d0) * (share * math.log(share / prior) + ((1 - share) * math.log((1 - share) / (1 - prior)) if d0 else 0.0))
            if evidence >= math.log(max(several, 1)) - 1:
                theta[f] = math.log((d1 + 0.5) / n1 / ((d0 + 0.5) / n0)) / 2
    names = list(theta)
    theta |= {"bias": T.BIAS, "leak": T.LEAK}
    mean, square = dict.fromkeys(theta, 0.0), dict.fromkeys(theta, 0.0)
    for t in range(1, rounds + 1):
        leak = 1 / (1 + math.exp(-theta["leak"]))
        grad = {f: 1e-3 * theta[f] / max(len(names), 1) for f in names} | {"bias": 0.0, "leak": 0.0}
        for doc, label in zip(docs, labels):
            kept = [[f for f in s if f in theta] for s in doc]
            chances = [1 / (1 + math.exp(-(theta["bias"] + sum(theta[f] for f in s)))) for s in kept if s]
            clean = math.log1p(-leak) + sum(math.log1p(-min(p, 1 - 1e-9)) for p in chances)
            pull = (-math.exp(clean) / max(-math.expm1(clean), 1e-9) if label else 1.0) / len(labels)
            for p, s in zip(chances, [s for s in kept if s]):
                grad["bias"] += pull * p
                for f in s:
                    grad[f] += pull * p
            grad["leak"] += pull * leak
        for f in theta:
            mean[f] = 0.9 * mean[f] + 0.1 * grad[f]
            square[f] = 0.999 * square[f] + 0.001 * grad[f] ** 2
            theta[f] -= 0.05 * (mean[f] / (1 - 0.9**t)) / (math.sqrt(square[f] / (1 - 0.999**t)) + 1e-8)
        theta["bias"], theta["leak"] = min(theta["bias"], T.BIAS), min(theta["leak"], T.LEAK)
    return {key_of(f): theta[f] for f in names}, theta["bias"], 1 / (1 + math.exp(-theta["leak"]))


def plain_score(text, weights, bias, leak, known):
    log = math.log1p(-leak)
    for sentence in plain_sentences(text):
        for f in sentence:
            if f not in known:
                known[f] = key_of(f)
        z = [weights[known[f]] for f in sentence if known[f] in weights]
        if z:
            log += math.log1p(-min(1 / (1 + math.exp(-max(-60, min(60, bias + sum(z))))), 1 - 1e-9))
    return -math.expm1(log)


def test_training(spark):
    rng = random.Random(7)
    clean, bad = [f"word{i}" for i in range(40)], ["scumbag", "idiotic", "Wretched", "ünfit"]
    texts, labels = [], []
    for i in range(60):
        label = int(i % 3 == 0)
        sentences = [" ".join(rng.choices(clean, k=5)) for _ in range(rng.randrange(1, 5))]
        if label:
            sentences.insert(rng.randrange(len(sentences) + 1), " ".join(rng.choices(bad, k=2) + rng.choices(clean, k=2)))
        texts.append(rng.choice([". ", "! ", "\n"]).join(sentences))
        labels.append(label)
    documents = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    model = T.train(documents, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    weights, bias, leak = plain_fit(texts, labels)
    assert len(weights) >= 4 and set(model.keys.tolist()) == set(weights)
    assert dict(zip(model.keys.tolist(), model.weights.tolist())) == pytest.approx(weights, rel=1e-6)
    assert (model.bias, model.leak) == pytest.approx((bias, leak), rel=1e-6)
    here = T.fit(texts, np.array(labels))
    assert here.keys.tolist() == sorted(model.keys.tolist()) and np.allclose(here.weights, model.weights)


def test_scores_of_all_documents(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = T.train(documents, table(spark, sf_dir, "labels").filter(~T.held_out()))
    weights, known = dict(zip(model.keys.tolist(), model.weights.tolist())), {}
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in Q.op6_toxicity(spark, sf_dir).collect():
        assert r.score == pytest.approx(plain_score(texts[r.doc_id], weights, model.bias, model.leak, known), abs=1e-9), r.doc_id


def test_held_out_figures(spark):
    folder = "/root/testdata/sf0.1"
    got = Q.op6_toxicity(spark, folder).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id").query("held_out")
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert len(toxic) > 50 and len(clean) > 500
    rank = got.score.rank()
    auc = (rank[got.toxic == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(clean))
    assert toxic.predicted.mean() >= 0.8 and clean.predicted.mean() <= 0.005 and auc >= 0.95
