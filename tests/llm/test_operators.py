"""Each operator against a plain version of the same contract, on the small table and on hand-made cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.llm import queries as Q
from tidewire.llm.common import components, table
from tidewire.llm.queries import tokenizer_path

LONG = "lorem ipsum " * 20_000
CASES = [
    (1, "the quick brown fox jumps over the lazy dog " * 3),
    (2, None),
    (3, ""),
    (4, "don't stop, we'll 've  'sabc's \n\n\t x1234 <|endoftext|>é中😀 "),
    (5, " "),
    (6, LONG),
    (7, "the quick brown fox jumps over the lazy dog " * 3),
    (8, "  two  spaces  "),
    (9, "one"),
    (9, "one"),
]


def cases(spark, rows=None):
    """With an extra column whose name an operator uses itself."""
    return spark.createDataFrame(CASES if rows is None else rows, "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("key", F.lit(1))


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def listed(df):
    return df.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)


def both(spark, documents):
    return [cases(spark), documents, cases(spark, [])]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def test_token_files(spark, documents, tmp_path):
    from tidewire.llm.token_files import TokenFile, read_documents, write_token_files

    tokenizer = library("word_bpe_49k.json")
    for n, df in enumerate(both(spark, documents)):
        manifest = write_token_files(df, tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/{n}", 1, 64)
        got = listed(read_documents(manifest))
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()))
        ids = [[*e.ids, 1] for e in tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False)]
        assert got.doc_id.tolist() == [d for d, _ in rows]
        assert got.n_tokens.tolist() == [len(x) for x in ids]
        assert got.start.tolist() == np.cumsum([0, *map(len, ids)])[:-1].tolist()
        assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
        shards = manifest.orderBy("shard").collect()
        files = [TokenFile(s.ids_path) for s in shards]
        assert [len(f) for f in files] == [s.n_sequences for s in shards]
        flat = [t for f in files for i in range(len(f)) for t in f.sequence(i)[f.mask(i)].tolist()]
        assert flat == [i for x in ids for i in x]
        for s, f in zip(shards, files):
            at, size = f.batches[0].column("ids").values.buffers()[1].address, f.batches[0].column("ids").values.buffers()[1].size
            x = f.sequence(0)
            assert x.shape == f.mask(0).shape == (64,) and x.dtype == np.uint16 and not x.flags.owndata
            assert at <= x.ctypes.data < at + size and any(int(a, 16) <= x.ctypes.data < int(b, 16) and s.ids_path.endswith(name) for a, b, name in maps())


def maps():
    """(first address, end address, file name) of the files mapped into memory."""
    with open("/proc/self/maps") as f:
        for line in f:
            part = line.split()
            if len(part) == 6 and part[5].startswith("/"):
                yield *part[0].split("-"), part[5]


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]


def test_url_filter(spark):
    from tidewire.llm.url_filter import BlockedBloom, filter_urls

    urls = ["http://A.Example.NET/en/x?y://z", "https://example.net/de", "x://sub.example.com/de/", "http://example.com/de", "http://org", "http://org/fr/",
            "http://xorg/fr/", None, "", "no scheme", "http://net", "http://net/", "http://a.net?/en/", "http://a.org/fr/a#b", "http:///x"] * 2
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string").withColumns({"hit": F.lit(1), "key": F.lit(2), "best": F.lit(3), "a b": F.lit(4)})
    rules = spark.createDataFrame(Q.URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: r for r in filter_urls(pages, rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = plain_url(u)
        fits = [r for r in Q.URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        assert (got[i].host, got[i].path) == (host, path), u
        assert (got[i].rule, got[i].verdict) == ((best[0] + best[1], best[2]) if best else (None, "allow")), u
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in filter_urls(pages, rules.limit(0)).collect()} == {"allow"}
    keys = spark.range(300).select(F.col("id").cast("string").alias("k"))
    bloom = BlockedBloom(keys, "k")
    assert keys.filter(~bloom.holds(F.col("k"))).count() == 0
    others = spark.range(1000, 11000).select(F.col("id").cast("string").alias("k"))
    assert others.filter(bloom.holds(F.col("k"))).count() < 500


def plain_similarity(a, b):
    def bag(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        return Counter(tuple(w[i : i + 5]) for i in range(max(min(len(w), 1), len(w) - 4)))

    a, b = bag(a), bag(b)
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 0.0


def plain_classes(rows, at_least=0.8):
    ids = sorted({d for d, _ in rows if d is not None})
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").lower())
        for i in range(max(min(len(w), 1), len(w) - 4)):
            by_shingle.setdefault(tuple(w[i : i + 5]), set()).add((d, t))
    done = set()
    for docs in by_shingle.values():
        docs = sorted(docs, key=lambda x: x[0])
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                if (a, b) not in done:
                    done.add((a, b))
                    if plain_similarity(a[1], b[1]) >= at_least:
                        x, y = sorted((find(a[0]), find(b[0])))
                        root[y] = x
    return {d: find(d) for d in ids}


def test_minhash(spark, documents):
    from tidewire.llm.minhash import near_duplicates

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    made = []
    for i in range(60):  # a chain: each differs a little from the last, the ends differ much
        base[(i * 7) % 200] = f"v{i}"
        made.append((1000 + i, " ".join(base)))
    for rows in (CASES, made, [(r.doc_id, r.text) for r in documents.collect()], []):
        got = listed(near_duplicates(cases(spark, rows)))
        assert sorted(got.doc_id) == sorted(d for d, _ in rows)
        assert dict(zip(got.doc_id, got.class_id)) == plain_classes(rows)
        assert (got.kept == (got.doc_id == got.class_id)).all()


def test_dart_signatures_estimate_weighted_similarity():
    from tidewire.llm.minhash import dart_signatures

    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 5, 400).astype(float), rng.integers(0, 5, 400).astype(float)
    b[:300] = a[:300]
    b[5] = 2.5
    keys = rng.integers(0, 2**63, 400).astype(np.uint64)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.repeat([0, 1], 400)
    w, k = np.concatenate((a, b)), np.concatenate((keys, keys))
    s = dart_signatures(row[w > 0], k[w > 0], w[w > 0], 3, 4096)
    assert abs((s[0] == s[1]).mean() - true) < 0.03
    assert (s[2] == 0).all() and (s[:2] > 0).all()


def plain_cut(rows, size=20):
    seen, out = {}, {}
    ordered = sorted((d, re.findall("[^\x20\x09-\x0d]+", t or "")) for d, t in {(d, t or "") for d, t in rows})
    for d, w in ordered:
        gone = set()
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            if key in seen:
                gone.update(range(i, i + size))
            else:
                seen[key] = d
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def test_substring(spark, documents):
    from tidewire.llm.substring import remove_duplicates

    rng = random.Random(2)
    few = [" ".join(rng.choice("ab") for _ in range(rng.randrange(80))) for _ in range(60)]  # windows and grams recur everywhere
    passage = [f"p{i}" for i in range(70)]
    mixed = []
    for i in range(60):
        w = [f"u{rng.randrange(10**6)}" for _ in range(60)]
        a, n = rng.randrange(50), rng.randrange(15, 50)
        at = rng.randrange(60)
        w[at:at] = passage[a : a + n]
        mixed.append((i, " ".join(w)))
    for rows in (CASES, list(enumerate(few)), mixed, [(r.doc_id, r.text) for r in documents.collect()], []):
        got = listed(remove_duplicates(cases(spark, rows)))
        want = plain_cut(rows)
        assert len(got) == len(rows)
        bad = [d for d, *x in got[["doc_id", "n_words", "n_removed", "kept_sha256"]].itertuples(index=False) if tuple(x) != want[d]]
        assert not bad
    kept = {r.doc_id: r.kept for r in remove_duplicates(cases(spark), ["kept", "key"]).collect()}
    assert kept[2] is None and kept[3] == "" and kept[7] == ""


def test_packing(spark, documents):
    from tidewire.llm.packing import best_fit_decreasing, pack_documents, pack_histogram

    tokenizer = library("byte_bpe_50k.json")
    for df in both(spark, documents):
        got = pack_documents(df, tokenizer_path("byte_bpe_50k.json"), 2).toPandas()
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
            first = len(ids) % 1024 or 1024
            for p, s in enumerate([0, *range(first, len(ids), 1024)]):
                part = ids[s : first if p == 0 else s + 1024]
                want[(r.doc_id, p, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
        assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert s.offset.tolist() == np.cumsum([0, *s.length])[:-1].tolist() and s.length.sum() <= 1024
        n = got.sequence_id.nunique()
        assert n <= sum(best_fit_decreasing(Counter(got.length), 1024).values()) and n * 1024 >= got.length.sum()
    assert sum(k for _, k in pack_histogram({600: 10, 424: 10, 512: 4, 1024: 3})) == 15


def test_toxicity(spark, sf_dir):
    from tidewire.llm.toxicity import fit, score_documents

    got = Q.op6_toxicity(spark, sf_dir).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()
    truth = got.merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id").query("held_out")
    assert ((truth.toxic == 1) == (truth.predicted == 1)).mean() > 0.95
    model = fit(["a nice day. you are awful scum! bye", "a nice day. good morning to you", "awful scum", "hello there"] * 30, np.array([1, 0, 1, 0] * 30))
    rows = score_documents(cases(spark, [*CASES, (20, "Hello. You are awful scum. Bye.")]).withColumn("score", F.lit(2)), model, ["key", "score"]).toPandas().set_index("doc_id")
    assert rows.loc[20, "score"] > 0.5 and rows.loc[1, "score"] < 0.5 and rows.loc[[2, 3], "score"].max() < 0.5
    worst = rows.loc[[20]].iloc[0]
    assert "Hello. You are awful scum. Bye."[int(worst.worst_start) : int(worst.worst_end)].strip() == "You are awful scum."
    assert score_documents(cases(spark, []), fit([], np.zeros(0, int))).count() == 0


def test_sentencepiece(spark, documents):
    from tidewire.llm.sentencepiece_codec import codec, decode_documents, encode_documents

    path = tokenizer_path("piece_bpe_32k.model")
    lib = codec(path).library
    for df in both(spark, documents):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        got = listed(encode_documents(df, path, digests=True))
        for d, n, covered, size, i, t in got[["doc_id", "n_tokens", "covered_bytes", "n_bytes", "ids_sha256", "decoded_sha256"]].itertuples(index=False):
            ids = [*lib.encode(texts[d]), lib.eos_id()]
            assert n == len(ids) and covered == size == len(texts[d].encode())
            assert i == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert t == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    full = encode_documents(cases(spark), path)
    for r in full.collect():
        text = dict(CASES)[r.doc_id] or ""
        for i, a, b in zip(r.ids, r.begins, r.ends):
            piece = lib.id_to_piece(i)
            if not piece.startswith("<0x") and i > 2 and not lib.is_byte(i):
                assert text.encode()[a:b].decode().replace(" ", "▁") in (piece, piece[1:])
    back = {r.doc_id: r.text for r in decode_documents(full, path).collect()}
    assert all(back[d] == (t or "") for d, t in CASES)


def test_sentencepiece_character_map():
    """The library's own normaliser has a compiled map."""
    import sentencepiece

    from tidewire.llm.sentencepiece_codec import Normalizer

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto.FromString(rule.serialized_model_proto()).normalizer_spec
    own = Normalizer(spec.precompiled_charsmap, True, True, True)
    for text in ("", "  ", "ﬁne　ＡＢＣ ｶﾞ  x ", "①② ㍿ é e\u0301", "plain text", "\u200bzero\u00a0nb"):
        got, align = own.normalize(text.encode())
        assert got.decode() == rule.normalize(text), text
        assert len(align) == len(got) + 1 and align == sorted(align) and align[-1] <= len(text.encode())


def mapped_model(path) -> str:
    """A model with a compiled character map and a few stated pieces, without byte pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    model = sentencepiece_model_pb2.ModelProto.FromString(rule.serialized_model_proto())
    model.ClearField("pieces")
    kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
    for piece, score, kind in [("<unk>", 0, kinds.UNKNOWN), ("<s>", 0, kinds.CONTROL), ("</s>", 0, kinds.CONTROL), *[(x, -3.0 + len(x), kinds.NORMAL) for x in ["▁", *"abcefinABC1", "▁a", "fi", "fin", "▁fine", "ABC", "é", "ガ"]]]:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    path.write_bytes(model.SerializeToString())
    return str(path)


def test_spans_through_a_character_map(spark, tmp_path):
    """Ids and spans as the library's own, where characters change, vanish, merge or are unknown."""
    import sentencepiece

    from tidewire.llm.sentencepiece_codec import encode_documents

    path = mapped_model(tmp_path / "mapped.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(7)
    parts = ["ﬁne", "　", " ", "  ", "ＡＢＣ", "ｶﾞ", "①", "é", "e\u0301", "a", "b", "中文", "😀", "z", "\u200b", "\u00a0", "\n", "㍿"]
    texts = ["", " ", None, "中", "中文 ﬁne", *["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300)]]
    got = encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    for r in got.collect():
        text = texts[r.doc_id] or ""
        want = library.encode(text, return_type="proto").pieces
        assert r.ids == [p.id for p in want] + [2]
        raw = text.encode()
        assert [raw[a:b].decode() for a, b in zip(r.begins, r.ends)] == [p.surface for p in want] + [""], text


def test_token_counts(spark, documents):
    from tidewire.llm.token_counts import TokenCounter, count_tokens

    tokenizer = library("byte_bpe_50k.json")
    for df in both(spark, documents):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        for r in count_tokens(df, tokenizer_path("byte_bpe_50k.json"), 1024).collect():
            n = len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 1024)
    rng, alphabet = random.Random(1), ["a", "b", "'", "s", "t", "l", "v", "e", "r", " ", "  ", "\n", "\u00a0", "\u3000", "é", "1", "!", "<|endoftext|>", "\x1c", "\x85", "中", "😀", "٣", "'ll", "'re", " the"]
    fuzz = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(2000)]
    import pyarrow as pa

    from tidewire.llm.textscan import slices

    counter, got = TokenCounter(tokenizer_path("byte_bpe_50k.json")), []
    for _, _, data, offsets in slices(pa.array(fuzz), 5000):
        got += counter.count(data, offsets).tolist()
    assert got == [len(e.ids) for e in tokenizer.encode_batch(fuzz, add_special_tokens=False)]


def vectors(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 200):  # near copies of few vectors, and equal ones
        x[i] = x[i % 5] + rng.normal(size=16) * (0.03 if i % 3 else 0)
    return x.astype(np.float32)


ODD = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] + [1.0] * 15, 1), (5003, [None] + [1.0] * 15, 2), (5050, [float("inf")] * 16, 1), (5051, [], 1)]


def embeddings(spark):
    x = vectors()
    rows = [(i, x[i].tolist(), None if i == 7 else i % 3) for i in range(len(x))] + ODD
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("x")), rows


def plain_top_k(rows, k=5, every=50):
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(object)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all()]
    good = [(i, [int(x) for x in v]) for i, v in good]
    want = []
    for n, (q, v) in enumerate(good):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), i) for m, (i, w) in enumerate(good) if m != n)[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(want)


def test_top_k(spark, sf_dir):
    from tidewire.llm.topk import top_k

    df, rows = embeddings(spark)
    odd = [(50, [1.0] * 3), (50, [2.0] * 3), (50, [2.0] * 3), (51, [9e6, 1.0]), (52, [9e6, 2.0, 3.0]), (53, [-9e6]), (100, [float(i) for i in range(40)])]
    for frame, data in ((df, [r[:2] for r in rows]), (df.limit(0), []), (spark.createDataFrame(odd, "vec_id long, embedding array<double>"), odd)):
        got = sorted(top_k(frame).select("query_id", "rank", "vec_id", "score").toPandas().itertuples(index=False, name=None))
        assert got == plain_top_k(data)
    with pytest.raises(ValueError):
        top_k(spark.createDataFrame([(1, [1e12])], "vec_id long, embedding array<double>"))


def test_top_k_in_many_cells(spark, monkeypatch):
    """Small cells: queries expand over annuli in rounds, and most cells are never searched."""
    from tidewire.llm import topk

    monkeypatch.setattr(topk, "CELL", 40)
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(30, 4)) * 4)[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 4)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(topk.top_k(frame, every=500).toPandas().itertuples(index=False, name=None))
    assert got == plain_top_k(rows, every=500)


def linked(rows, cosine=0.98):
    """(number of links, smallest id that can be reached) by comparing all pairs of equal label and dimension."""
    links, root = Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    alike = {}
    for i, v, label in rows:
        if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and label is not None:
            alike.setdefault((label, len(v)), []).append((i, np.array(v, float)))
    for group in alike.values():
        ids, x = [i for i, _ in group], np.array([v for _, v in group])
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        for i, j in np.argwhere(np.triu(x @ x.T >= cosine, 1)).tolist():
            links[ids[i]] += 1
            links[ids[j]] += 1
            a, b = sorted((find(ids[i]), find(ids[j])))
            root[b] = a
    return links, {i: find(i) for i in root}


def test_embedding_dedup(spark, sf_dir):
    from tidewire.llm.embedding_dedup import near_duplicate_vectors

    df, rows = embeddings(spark)
    stored = table(spark, sf_dir, "embeddings")
    mixed = [(i, [1.0, 0.0, 0.0001 * i], "a") for i in range(4)] + [(10 + i, [1.0, 1.0], "a") for i in range(2)] + [(20, [1.0, 0.0, 0.0], "b"), (21, [1e300, 0.0, 0.0], "a"), (22, [1e-300, 0.0, 0.0], "a")]
    for frame, data in ((df, rows), (stored, [(r.vec_id, r.embedding, r.label) for r in stored.collect()]), (spark.createDataFrame(mixed, "vec_id long, embedding array<double>, label string"), mixed)):
        got = near_duplicate_vectors(frame).toPandas().set_index("vec_id")
        links, root = linked(data)
        assert len(got) == len(data)
        assert all(got.loc[i, "n_links"] <= links[i] for i in root)
        assert got.n_links.sum() >= 0.99 * sum(links.values()) and (sum(links.values()) > 0 or frame is stored)
        assert (got.component_id == [root[i] for i in got.index]).mean() > 0.99
        assert (got.kept == (got.component_id == got.index)).all()
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def test_embedding_dedup_with_probes(spark, monkeypatch):
    """The wide parts that tables of many vectors get, with every bit turned over once."""
    from tidewire.llm import embedding_dedup as E

    found = E._found
    monkeypatch.setattr(E, "_found", lambda reps, model, width, tables, probes, cosine: found(reps, model, width, 4, 1, cosine))
    df, rows = embeddings(spark)
    got = E.near_duplicate_vectors(df).toPandas().set_index("vec_id")
    links, _ = linked(rows)
    assert all(got.loc[i, "n_links"] <= links[i] for i in got.index)
    assert got.n_links.sum() >= 0.99 * sum(links.values()) > 1000


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in root.items() if n in got} and all(root[n] == n for n in root.keys() - got.keys())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, sf_dir):
    """run() against the plain versions, stage by stage; toxicity's noisy-or is redone by loops."""
    import corpus_pipeline
    from tidewire.llm.toxicity import _features, train

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]
    documents = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    model = train(documents, table(spark, sf_dir, "labels"))
    weights = dict(zip(model.keys.tolist(), model.weights.tolist()))
    kept = []
    for d, t in rows:
        data = np.frombuffer((t or "").lower().encode(), np.uint8)
        keys, owner, bounds, _ = _features(data, np.array([0, len(data)]))
        z = {}
        for k, o in zip(keys.tolist(), owner.tolist()):
            if k in weights:
                z[o] = z.get(o, model.bias) + weights[k]
        if (1 - model.leak) * np.prod([1 - 1 / (1 + np.exp(-x)) for x in z.values()]) > 0.5:
            kept.append((d, t))
    assert 0 < len(kept) < len(rows)
    classes = plain_classes(kept)
    kept = [(d, t) for d, t in kept if classes[d] == d]
    seen, cut = set(), []
    for d, t in sorted(kept):
        w, gone = re.findall("[^\x20\x09-\x0d]+", t), set()
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone.update(range(i, i + 20))
            seen.add(key)
        cut.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    tokenizer, want = library("byte_bpe_50k.json"), Counter()
    for d, t in cut:
        n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
        want.update((d, p, m) for p, m in enumerate([n % 1024 or 1024, *[1024] * ((n - 1) // 1024)]))
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert Counter(got[["doc_id", "piece", "length"]].itertuples(index=False, name=None)) == want
    assert (got.groupby("sequence_id").length.sum() <= 1024).all()


def test_pipeline_stages_keep_columns(spark, sf_dir):
    import corpus_pipeline

    rows = [(1, "hello world " * 30, "en", "a", 360), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "hello world " * 30, "en", "b", 360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, sf_dir)
            assert out.columns == docs.columns, name
            ids = sorted(r.doc_id for r in out.collect())
            assert ids == ([] if part is not docs else [1, 2, 3] if name == "minhash_near_dedup" else [1, 2, 3, 4]), name


def test_packing_is_near_its_lower_bound():
    from itertools import product

    from tidewire.llm.packing import best_fit_decreasing, lower_bound, pack_histogram

    def least(lengths, size):
        """By trying: the fewest sequences of a few pieces."""
        best = len(lengths)
        for places in product(range(len(lengths)), repeat=len(lengths)):
            loads = [0] * len(lengths)
            for p, s in zip(places, lengths):
                loads[p] += s
            if max(loads) <= size:
                best = min(best, sum(x > 0 for x in loads))
        return best

    rng = random.Random(3)
    for _ in range(40):
        lengths = [rng.randrange(1, 21) for _ in range(6)]
        h = {s: lengths.count(s) for s in lengths}
        best, plan = least(lengths, 20), sum(n for _, n in pack_histogram(h, 20))
        assert lower_bound(h, 20) <= best <= plan <= sum(best_fit_decreasing(h, 20).values())
    for seed in range(4):
        rng = random.Random(seed)
        h: dict[int, int] = {}
        for _ in range(3000):
            s = min(1024, int(rng.lognormvariate(5.5, 1)) + 1)
            h[s] = h.get(s, 0) + 1
        bound, plan = lower_bound(h), sum(n for _, n in pack_histogram(h))
        assert -(-sum(s * n for s, n in h.items()) // 1024) <= bound <= plan <= bound + 2
    assert lower_bound({}) == 0


def test_embedding_dedup_looks_codes_up_alike_at_every_size(spark, monkeypatch):
    """Also where the number of vectors passes what once was a limit."""
    from tidewire.llm import embedding_dedup as E

    found, seen = E._found, []
    monkeypatch.setattr(E, "_found", lambda reps, model, width, tables, probes, cosine: seen.append((tables, probes)) or found(reps, model, width, tables, probes, cosine))
    for rows in ([(i, [1.0, 0.01 * i, 0.5], "a") for i in range(4)],):
        assert E.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).count() == 4
    assert seen == [(4, 1)]
