"""Texts that sums of powers can't tell apart, and long texts that are taken in parts."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tidewire.llm.queries import tokenizer_path


def thue_morse(n, a, b):
    return [a if i.bit_count() % 2 else b for i in range(n)]


PAIRS = ["".join(thue_morse(2048, x, y)) for x, y in ("ab", "ba")] + [" ".join(thue_morse(1024, x, y)) for x, y in ("ab", "ba")]


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu'é中,.") for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    return " ".join(rng.choice(words) + rng.choice(["", "", ".", "\n\n", "  "]) for _ in range(420_000))


def bytes_of(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoders(name, long_text):
    from tokenizers import Tokenizer

    from tidewire.llm.chunks import json_tokenizer
    from tidewire.llm.textscan import SLICE_BYTES

    encoder, library = json_tokenizer(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    assert len(long_text.encode()) > 2 * SLICE_BYTES
    for text in [*PAIRS, long_text]:
        ids, counts = encoder.encode(*bytes_of(text))
        want = library.encode(text, add_special_tokens=False).ids
        assert counts.tolist() == [len(want)] and ids.tolist() == want


@pytest.fixture
def counted_texts(monkeypatch):
    """How many texts the library gets: (a new encoder of the vocabulary that drops white space, list of their numbers)."""
    import tokenizers

    from tidewire.llm.chunks import json_tokenizer

    asked = []

    class Counted:
        def __init__(self, path):
            self.inner = real.from_file(path)

        from_file = classmethod(lambda cls, path: cls(path))

        def encode_batch_fast(self, texts, **options):
            asked.append(len(texts))
            return self.inner.encode_batch_fast(texts, **options)

        def __getattr__(self, name):
            return getattr(self.inner, name)

    real = tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    return json_tokenizer.__wrapped__(tokenizer_path("word_bpe_49k.json")), asked


def test_new_words_share_texts(counted_texts):
    encoder, asked = counted_texts
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinSHRDLUéñß") for _ in range(rng.randrange(4, 14))) for _ in range(5000)]
    text = " ".join(words)
    ids, _ = encoder.encode(*bytes_of(text))
    assert ids.tolist() == library(text)
    assert sum(asked) < 100  # not one for each word
    # the same words with marks behind them bring only the marks
    asked.clear()
    text = " ".join(w + rng.choice(["$$$", "&&&", ".", ")", "'s", "7"]) for w in words)
    ids, _ = encoder.encode(*bytes_of(text))
    assert ids.tolist() == library(text)
    assert sum(asked) < 10


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def test_words_of_any_characters():
    from tokenizers import Tokenizer

    from tidewire.llm.chunks import json_tokenizer

    rng = random.Random(4)
    signs = [*"aAbBsStdérRlLmMveéÉñÑ×÷ßÿĀİſΣς''''..,-_$&<|>/\\19 \t\n\r\x0b\x01\xa0\u0301\u0307\u0331\u0338\u2028中🙂Å", "<|endoftext|>", "<|startoftext|>", "</w>", "'ll", "'RE", "  "]
    texts = ["".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(20_000)]
    encoder, library = json_tokenizer(tokenizer_path("word_bpe_49k.json")), Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    sizes = [len(t.encode()) for t in texts]
    ids, counts = encoder.encode(bytes_of("".join(texts))[0], np.cumsum([0, *sizes]))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    at = np.cumsum([0, *counts]).tolist()
    assert [t for t, a, b, w in zip(texts, at, at[1:], want) if ids[a:b].tolist() != w] == []


def test_codec(long_text):
    from tidewire.llm.sentencepiece_codec import codec

    it = codec(tokenizer_path("piece_bpe_32k.model"))
    for text in [*PAIRS, long_text]:
        ids, counts, begins, ends = it.encode(*bytes_of(text))
        assert ids.tolist() == it.library.encode(text) and counts.tolist() == [len(ids)]
        assert begins[0] == 0 and ends[-1] == len(text.encode())


def test_counter(long_text):
    from tokenizers import Tokenizer

    from tidewire.llm.token_counts import TokenCounter

    counter, library = TokenCounter(tokenizer_path("byte_bpe_50k.json")), Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(2)
    unbroken = "".join(rng.choice("abcdeiou") for _ in range(9000))  # one piece, run in chunks
    for text in [*PAIRS, unbroken, "-" * 7001, long_text]:
        assert counter.count(*bytes_of(text)).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


def test_cache_keeps_the_frequent_half():
    from tidewire.llm.chunks import PieceCache
    from tidewire.llm.textscan import byte_hashes, eights

    words = [f"w{i}" for i in range(100)]
    data, _ = bytes_of("".join(words))
    ends = np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    keys, cache = byte_hashes(data, starts, ends), PieceCache()
    cache.add(keys, data, starts, ends - starts)
    cache.find(keys[50:], eights(data), starts[50:], (ends - starts)[50:])
    smaller, kept = cache.halve()
    assert kept.tolist() == list(range(50, 100))
    assert (smaller.find(keys, eights(data), starts, ends - starts) >= 0).tolist() == [False] * 50 + [True] * 50
    # another piece under a known key isn't found
    assert cache.find(keys[:1], eights(data), starts[1:2], (ends - starts)[1:2]).tolist() == [-2]


def test_toxicity_of_a_long_text_is_that_of_its_sentences():
    from tidewire.llm.toxicity import fit

    model = fit(["a nice day. you are awful scum! bye", "a nice day. good morning to you"] * 60, np.array([1, 0] * 60))
    table = model.table()
    clean, bad = "a nice day. " * 200_000, "you are awful scum. "
    for text, worst in ((clean, None), (clean + bad + clean, len(clean))):
        score, n, start, end = model.scores(*bytes_of(text), table)
        assert (score[0] > 0.5) == (worst is not None)
        if worst:
            assert text[int(start[0]) : int(end[0])].strip() == bad.strip()


def test_substring_and_digests_tell_texts_apart():
    from tidewire.llm.minhash import digests
    from tidewire.llm.textscan import WordRuns, slices

    for _, _, data, offsets in slices(pa.array([*PAIRS, "", "  ", "a  b", "a b", None])):
        got = digests(data, WordRuns(data, offsets))
    assert len(set(got[:4])) == 4 and got[4] == got[5] == got[8] and got[6] == got[7]


def test_windows_that_differ_in_one_word(spark):
    from tidewire.llm.substring import remove_duplicates

    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{PAIRS[0]} {rest}"), (2, f"{PAIRS[1]} {rest}"), (3, f"{PAIRS[0]} {rest}"), (4, "one"), (4, f"x {PAIRS[0]} {rest}")]
    got = {(r.doc_id, r.n_words): r.n_removed for r in remove_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 20): 0, (2, 20): 0, (3, 20): 20, (4, 1): 0, (4, 21): 20}
