"""Encoding with a tokenizer library, each distinct chunk of text once per cache.

Long texts repeat few distinct words, so a text is cut where no token of the vocabulary can reach across, each
distinct piece goes through the library once, and its ids are looked up afterwards. The ids equal those of the whole text.

- `leading` (byte-level vocabularies): cut before white space that follows a character which is surely none, and
  between a letter and a mark; a piece is its leading white space and the run after it.
- `spaces` (piece vocabularies): cut before a space that follows another character.
- `lone space`: like `spaces`, if a printable ASCII character follows.
- `dropped` (vocabularies that drop white space): cut at white space, which belongs to no piece, and between a letter
  (ASCII, or of two bytes up to U+00FF) and any other printable ASCII character that no added token holds. So most
  pieces are one word, and many of these go through the library as one text, whose ids tell where words end.

"Surely none" are printable ASCII and two-byte characters from U+00C0 on; after others the text isn't cut.

A piece is looked up by a hash of its bytes, and the bytes are compared: a piece whose hash is another one's goes through
the library itself. A long row is taken in parts of bounded size, parted where a piece begins.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np

from tidewire.llm.textscan import LONG_RUN, SLICE_BYTES, KeyTable, byte_hashes, eights, equal_runs, ragged

#: Distinct pieces, of at most LONG_RUN bytes each, kept per worker process; when there are more, the rarer half goes.
CACHE_PIECES = 300_000

_WHITE = b" \t\r\n"


def _among(values: Sequence[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_BLANK, _PLAIN, _LEADS_TWO = _among(_WHITE), _among(range(0x21, 0x7F)), _among(range(0xC3, 0xE0))
_LETTER, _MARK = _among([*range(0x41, 0x5B), *range(0x61, 0x7B)]), _among(b".,!?;:")
#: In mode `dropped`: what may be cut off a letter before it, and the second bytes of the letters U+00C0 to U+00FF.
_NO_LETTER, _LATIN = _PLAIN & ~_LETTER & ~_among(b"<|>"), _among({*range(0x80, 0xC0)} - {0x97, 0xB7})

#: The words of vocabularies that drop white space, and pieces that are surely one word each.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ONE_WORD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: So many of them make one text for the library.
_JOINED = 128


def cuts(data: np.ndarray, offsets: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of all rows."""
    n = len(data)
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    before = np.zeros(n, np.uint8)
    before[1:] = data[:-1]
    letter = _LETTER[before]
    if mode == "dropped":
        letter[2:] |= (data[:-2] == 0xC3) & _LATIN[before[2:]]
        mark = _NO_LETTER[data] & letter
        inside = ~_BLANK[data]
        starts = np.flatnonzero(inside & (row[:-1] | _BLANK[before] | mark | (np.arange(n) == 0)))
        edge = np.ones(n + 1, bool)
        edge[:-1] = row[:-1] | ~inside | mark
        ends = np.flatnonzero(inside & edge[1:]) + 1
        return starts, ends
    two = (before >= 0x80) & (before < 0xC0) & np.concatenate(([False, False], _LEADS_TWO[data[:-2]]))[:n]
    mark = _MARK[data] & letter
    space = _BLANK[data] if mode == "leading" else data == 0x20
    if mode == "lone space":
        space &= np.append(_PLAIN[data[1:]], False)
    starts = np.flatnonzero(row[:-1] | (space & (_PLAIN[before] | two)) | (mark & (mode == "leading")))
    return starts, np.append(starts[1:], n) if len(starts) else starts


def parts(data: np.ndarray, mode: str, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of one row, each of about `size` bytes, that begin where a piece begins."""
    a = 0
    while a < len(data):
        b, reach = a + size, size
        while b < len(data):
            # two bytes before the place tell whether it is a cut
            starts, _ = cuts(data[b - 2 : b + reach], np.array([0]), mode)
            found = starts[starts >= 2]
            if len(found):
                b += int(found[0]) - 2
                break
            b, reach = b + reach - 2, 2 * reach
        b = min(b, len(data))
        yield a, b
        a = b


class PieceCache:
    """Numbers pieces of bytes in order of arrival; a piece is found only if its bytes are the same."""

    def __init__(self):
        self.known = KeyTable()
        self.text, self.filled = np.zeros(1 << 16, np.uint8), 0
        self.begin, self.size, self.hits = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)

    def find(self, keys: np.ndarray, view: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The number of each piece; -1: new; -2: it can't be kept, since it is long or its key is another piece's."""
        number = self.known.lookup(keys)
        hit = np.flatnonzero(number >= 0)
        at = number[hit]
        same = self.size[at] == sizes[hit]
        same[same] = equal_runs(view, starts[hit][same], eights(self.text[: self.filled]), self.begin[at][same], sizes[hit][same])
        self.hits[: self.known.count] += np.bincount(at[same], minlength=self.known.count).astype(np.int32)
        number[hit[~same]] = -2
        number[sizes > LONG_RUN] = -2
        return number

    def add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Takes pieces of distinct new keys."""
        new, total = self.known.count, int(sizes.sum())
        while len(self.begin) < new + len(keys):
            self.begin, self.size, self.hits = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.size, self.hits))
        if len(self.text) < self.filled + total:
            grown = np.zeros(2 * (self.filled + total), np.uint8)
            grown[: self.filled] = self.text[: self.filled]
            self.text = grown
        self.begin[new : new + len(keys)] = self.filled + np.cumsum(sizes) - sizes
        self.size[new : new + len(keys)] = sizes
        self.text[self.filled : self.filled + total] = data[ragged(starts, sizes)]
        self.filled += total
        self.known.add(keys)

    def halve(self) -> tuple[PieceCache, np.ndarray]:
        """(a cache of the half of the pieces that were found most often, their numbers here)."""
        hits = self.hits[: self.known.count]
        kept = np.sort(np.argsort(-hits, kind="stable")[: len(hits) // 2])
        keys = np.zeros(len(hits), np.uint64)
        filled = self.known.keys != 0
        keys[self.known.values[filled]] = self.known.keys[filled]
        smaller = PieceCache()
        smaller.add(keys[kept], self.text, self.begin[kept], self.size[kept].astype(np.int64))
        return smaller, kept


class PieceEncoder:
    """encode(data, offsets) -> (ids of all rows one after another, number of ids of each row).

    library: gives the ids of a list of pieces; edit: what stands for a piece when it goes to the library alone, from
    the piece's bytes and whether it begins its row.
    """

    def __init__(self, library: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], mode: str, edit: Callable[[bytes, bool], bytes] | None = None):
        self.library, self.mode, self.edit = library, mode, edit
        self.clear()

    def clear(self) -> None:
        self.cache = PieceCache()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
            return self._encode(data, offsets, True)
        ids = [self._encode(data[a:b], np.array([0, b - a]), a == 0)[0] for a, b in parts(data, self.mode)]
        return np.concatenate(ids), np.array([sum(map(len, ids))])

    def _ask(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pieces = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        if self.edit:
            pieces = [self.edit(t, b) for t, b in zip(pieces, begins.tolist(), strict=True)]
        return self.library(pieces)

    def _encode(self, data: np.ndarray, offsets: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """whole: the rows begin here, and not before."""
        starts, ends = cuts(data, offsets, self.mode)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        view, sizes = eights(data), ends - starts
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = whole
        begins = begins[starts]
        # a piece that begins its row is another one, since it is encoded in another way
        keys = byte_hashes(data, starts, ends, view=view) ^ (begins & (self.edit is not None)).astype(np.uint64) << np.uint64(63)
        keys[keys == 0] = 1
        if self.cache.known.count > CACHE_PIECES:
            self._halve()
        piece = self.cache.find(keys, view, starts, sizes)
        new, raw = np.flatnonzero(piece == -1), data.tobytes() if (piece < 0).any() else b""
        if len(new):
            distinct, sample = np.unique(keys[new], return_index=True)
            first = new[sample]
            self._add(distinct, *self._ask(raw, starts[first], ends[first], begins[first]))
            self.cache.add(distinct, data, starts[first], sizes[first])
            piece[new] = self.cache.find(keys[new], view, starts[new], sizes[new])
        lone = np.flatnonzero(piece < 0)
        pool, at, size = self.pool, self.at[piece], self.size[piece].astype(np.int64)
        if len(lone):
            ids, n = self._ask(raw, starts[lone], ends[lone], begins[lone])
            at[lone], size[lone] = self.used + np.cumsum(n) - n, n
            pool = np.concatenate((pool[: self.used], ids))
        sums = np.concatenate(([0], np.cumsum(size)))
        return pool[ragged(at, size)], np.diff(sums[np.searchsorted(starts, offsets)])

    def _halve(self) -> None:
        cache, kept = self.cache.halve()
        at, size = self.at[kept], self.size[kept].astype(np.int64)
        self.cache = cache
        self.pool = self.pool[ragged(at, size)]
        self.used = len(self.pool)
        self.at, self.size = np.cumsum(size) - size, size.astype(np.int32)

    def _add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        new = self.cache.known.count
        while len(self.at) < new + len(keys):
            self.at, self.size = np.concatenate((self.at, self.at)), np.concatenate((self.size, self.size))
        if len(self.pool) < self.used + len(ids):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(self.used + len(ids), np.uint32)))
        self.at[new : new + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[new : new + len(keys)] = sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


def _flat(parts: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(chain.from_iterable(parts), np.uint32, int(sizes.sum())), sizes


def largest_id(path: str) -> int:
    """The largest id that a tokenizers file can give."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


def _word_library(tokenizer, suffix: str | None) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """For vocabularies that drop white space. suffix: ends the last token of each word, and no other."""
    final = np.zeros(1 + max(tokenizer.get_vocab(with_added_tokens=True).values()), bool)
    final[[i for token, i in tokenizer.get_vocab(with_added_tokens=False).items() if suffix and token.endswith(suffix)]] = True

    def library(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that are surely one word go many as one text, parted by spaces; the others go alone."""
        one = np.fromiter((bool(suffix and _ONE_WORD.fullmatch(p)) for p in pieces), bool, len(pieces))
        joint, rest = np.flatnonzero(one), np.flatnonzero(~one)
        words = [pieces[i] for i in joint.tolist()]
        texts = [b" ".join(words[k : k + _JOINED]) for k in range(0, len(words), _JOINED)]
        ids, n = _flat([e.ids for e in tokenizer.encode_batch_fast([t.decode() for t in (*texts, *(pieces[i] for i in rest.tolist()))], add_special_tokens=False)])
        held = int(n[: len(texts)].sum())
        at, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        size[joint] = np.diff(np.flatnonzero(final[ids[:held]]) + 1, prepend=0)
        size[rest] = n[len(texts) :]
        at[joint], at[rest] = np.cumsum(size[joint]) - size[joint], held + np.cumsum(size[rest]) - size[rest]
        return ids[ragged(at, size)], size

    return library


@cache
def json_tokenizer(path: str) -> PieceEncoder:
    """For a tokenizers file whose pieces can be cut as this module says; other pre-tokenizers are refused. One per
    worker process: its cache of pieces serves later tasks."""
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spec = json.loads(tokenizer.to_str())
    pre = spec["pre_tokenizer"] or {}
    dropped = pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed"
    places = _BLANK | (_NO_LETTER if dropped else _MARK)
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or places[list(t["content"].encode())].any() for t in spec["added_tokens"]):
        raise ValueError("added tokens that hold a place of a cut are not supported")
    if dropped and pre["pretokenizers"][0].get("pattern") == {"Regex": _WORDS}:
        return PieceEncoder(_word_library(tokenizer, spec["model"].get("end_of_word_suffix")), "dropped")
    if pre.get("type") != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"pre-tokenizer not supported: {pre.get('type')}")
    lengths = np.zeros(1 + max(tokenizer.get_vocab(with_added_tokens=True).values()), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        lengths[i] = len(token)  # a character stands for a byte
    for t in spec["added_tokens"]:
        lengths[t["id"]] = len(t["content"].encode())

    def library(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin with white space and end with a plain character go as one text: no token reaches across."""
        out: list[Sequence[int]] = [()] * len(pieces)
        joint = [i for i, p in enumerate(pieces) if p[0] in _WHITE and 0x20 < p[-1] < 0x7F]
        rest = sorted(set(range(len(pieces))) - set(joint))
        for i, e in zip(rest, tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        for k in range(0, len(joint), 8192):
            part = joint[k : k + 8192]
            ids = tokenizer.encode_batch_fast([b"".join(pieces[i] for i in part).decode()], add_special_tokens=False)[0].ids
            ends = np.searchsorted(np.cumsum(lengths[ids]), np.cumsum([len(pieces[i]) for i in part])) + 1
            for i, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = ids[a:b]
        return _flat(out)

    return PieceEncoder(library, "leading")
