"""Operator 8: token counts by finite-state transducers, without making tokens.

A byte-level BPE tokenizer is compiled into two deterministic transducers.

1. The pre-tokenizer: eight states over classes of characters with a bounded look-ahead. Every symbol is a map of the
   states to the states; the finitely many maps that arise by composition are numbered in a table, so the maps of
   chunks compose by table look-ups. A parallel prefix scan (within chunks, then over the chunks' maps, then back)
   gives the state before each character, and with it where pieces begin. Rows begin with a constant map.
2. The merges: a state stands for what a prefix of a piece can still do: the longest suffix that begins some token,
   and the last token and the relative count of every shorter prefix in its reach. Each transition is annotated with
   the tokens it emits (the change in the count of the prefix's encoding). A token can follow another in an encoding
   exactly if encoding both together gives both, so the last token of each prefix is unique. States and transitions
   are compiled when first needed and kept for the worker's life, all pieces of a slice step through them together.
   A long piece is cut into chunks that step together too, each from the state that the bytes before it suggest; where
   the chunk before ends in another state, the chunk is run again from that one.

What a piece emits is kept by the piece's bytes (a hash finds them, and they are compared). A long row is taken in
parts, parted where a piece begins whatever comes before.

Special strings in texts count one token each, as the tokenizers library does by default. Null texts are empty: no
tokens. Texts are counted whole, whatever their length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.common import map_arrow
from tidewire.llm.chunks import PieceCache, parts
from tidewire.llm.textscan import SLICE_BYTES, byte_hashes, eights, slices

#: Distinct pieces whose counts are kept, and compiled states; when there are more, the less used half goes.
MAX_PIECES = 300_000
MAX_STATES = 120_000
#: Longer pieces are cut into chunks of CHUNK bytes; so many bytes before a chunk suggest its first state.
CHUNK, WARM = 1024, 192

FRESH, LETTERS, NUMBERS, OTHERS, BLANKS, AHEAD, ONE_MORE, TWO_MORE = range(8)
#: Symbols: a letter, number or other character; an apostrophe that begins a one- or two-letter ending; white space
#: before white space or the end; a space before something else; other white space before something else; row start.
LETTER, NUMBER, OTHER, SHORT, LONG, INNER, SPACE, BREAK, START = range(9)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece begins with this character)."""
    if symbol == LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (FRESH if state == ONE_MORE else ONE_MORE), False
        return LETTERS, state not in (LETTERS, AHEAD)
    if symbol == NUMBER:
        return NUMBERS, state not in (NUMBERS, AHEAD)
    if symbol == OTHER or symbol in (SHORT, LONG) and state in (OTHERS, AHEAD):
        return OTHERS, state not in (OTHERS, AHEAD)
    if symbol in (SHORT, LONG):
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol == INNER:
        return BLANKS, state != BLANKS
    return {SPACE: AHEAD, BREAK: FRESH, START: FRESH}[symbol], symbol != START


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each symbol's map, composition of numbered maps, the maps)."""
    maps = {tuple(range(8)): 0}
    symbols = [tuple(_step(q, s)[0] for q in range(8)) for s in range(9)]
    listed = [tuple(range(8))]
    for m in listed:
        for s in symbols:
            new = tuple(s[q] for q in m)
            if new not in maps:
                maps[new] = len(listed)
                listed.append(new)
    compose = np.array([[maps[tuple(b[q] for q in a)] for b in listed] for a in listed], np.int16)
    return np.array([maps[s] for s in symbols], np.int16), compose, np.array(listed, np.int8)


def scan_states(symbols: np.ndarray, chunk: int = 64) -> np.ndarray:
    """The pre-tokenizer's state before each symbol, by a parallel prefix scan over chunks' maps."""
    number, compose, maps = _monoid()

    def scanned(m: np.ndarray) -> np.ndarray:
        """Inclusive composition of all maps up to each place."""
        if len(m) <= chunk:
            out, now = np.empty_like(m), 0
            for i, x in enumerate(m.tolist()):
                now = compose[now, x]
                out[i] = now
            return out
        rows = -(-len(m) // chunk)
        padded = np.zeros(rows * chunk, m.dtype)
        padded[: len(m)] = m
        grid = np.ascontiguousarray(padded.reshape(rows, chunk).T)
        for i in range(1, chunk):
            grid[i] = compose[grid[i - 1], grid[i]]
        before = np.concatenate((np.zeros(1, m.dtype), scanned(grid[-1].copy())[:-1]))
        return compose[before[None, :], grid].T.reshape(-1)[: len(m)]

    return maps[np.concatenate((np.zeros(1, np.int16), scanned(number[symbols])[:-1])), FRESH] if len(symbols) else np.zeros(0, np.int8)


@cache
def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, for every code point."""
    import regex

    out = np.full(0x110000, 2, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((0, r"\p{L}+"), (1, r"\p{N}+"), (3, r"\s+")):
        for m in regex.finditer(pattern, everything):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind if b - a + 1 == len(m[0]) else out[a : b + 1]
            if b - a + 1 != len(m[0]):
                out[[ord(c) for c in m[0]]] = kind
    out[0x1C:0x20] = 2
    return out


def _is_in(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_ONE, _VR = _is_in(b"stmd"), _is_in(b"vr")


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where pre-tokenizer pieces begin."""
    n = len(data)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    codes = data[at].astype(np.int64)
    wide = np.flatnonzero(codes >= 0x80)
    if len(wide):
        padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
        p, first = at[wide], codes[wide]
        size = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
        code = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            code = np.where(size > k, (code << 6) | (padded[p + k] & 0x3F), code)
        codes[wide] = code
    kind = _classes()[codes]
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    last = row[np.append(at[1:], n)]  # the row ends after this character
    blank = kind == 3
    next_blank = last | np.append(blank[1:], True)
    symbols = kind.copy()
    symbols[blank] = np.where(next_blank, INNER, np.where(codes == 0x20, SPACE, BREAK))[blank]
    ticks = np.flatnonzero(codes == 0x27)
    if len(ticks):
        low = np.where(codes < 0x80, codes, 0).astype(np.uint8)
        one = np.append(low[1:], [0, 0])[ticks] * ~last[ticks]
        two = np.append(low[2:], [0, 0, 0])[ticks] * ~(last[ticks] | np.append(last[1:], True)[ticks])
        symbols[ticks[_ONE[one]]] = SHORT
        symbols[ticks[(_VR[one] & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))]] = LONG
    # a row's start is a symbol of its own before its first character
    first = np.flatnonzero(row[at])
    place = np.arange(len(at)) + np.cumsum(row[at])
    stream = np.full(len(at) + len(first), START, np.uint8)
    stream[place] = symbols
    states = scan_states(stream)[place]
    begins = np.array([[_step(q, s)[1] for s in range(9)] for q in range(8)])
    return at[begins[states, symbols]]


class MergeTransducer:
    """Counts the tokens of pieces; compiled on demand from the vocabulary and the merges."""

    def __init__(self, tokens: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int]):
        self.tokens, self.ranks = tokens, ranks
        self.prefixes = {t[:k] for t in tokens for k in range(1, len(t) + 1)}
        self.follows = lru_cache(200_000)(self._follows)
        self.alone = lru_cache(100_000)(lambda t: len(self._merge(t)) == 1)
        self.clear()

    def clear(self) -> None:
        start = (b"", ((0, b""),))
        self.numbers, self.states = {start: 0}, [start]
        self.shared: dict = {}  # one object for each suffix and for each place that several states have
        #: Next state in the low 24 bits, emitted tokens + 64 above; -1 where not compiled.
        self.table = np.full((1 << 12, 256), -1, np.int32)
        self.visits = np.zeros(1 << 12, np.int64)

    def halve(self) -> None:
        """Keeps the half of the states that were passed most often; what led to others is compiled again."""
        n = len(self.states)
        rank = self.visits[:n].copy()
        rank[0] = 1 << 62
        kept = np.sort(np.argsort(-rank, kind="stable")[: n // 2])
        number = np.full(n, -1, np.int32)
        number[kept] = np.arange(len(kept), dtype=np.int32)
        table = self.table[kept]
        to = number[np.where(table < 0, 0, table & 0xFFFFFF)]
        table = np.where((table < 0) | (to < 0), -1, to | (table >> 24) << 24)
        self.table = np.full((max(1 << 12, len(kept)), 256), -1, np.int32)
        self.table[: len(kept)] = table
        self.states = [self.states[i] for i in kept.tolist()]
        self.numbers = {s: i for i, s in enumerate(self.states)}
        self.shared = {p: p for _, places in self.states for p in places if p}
        self.visits = np.zeros(len(self.table), np.int64)

    def _one(self, x):
        return self.shared.setdefault(x, x)

    def _merge(self, text: bytes) -> list[bytes]:
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _follows(self, a: bytes, b: bytes) -> bool:
        return self._merge(a + b) == [a, b]

    def compile(self, state: int, byte: int) -> None:
        """A state: the suffix that begins some token, and for each place in it (the first: before it) from which a
        token may still grow, the count of tokens up to there, relative to the last place, and the token that ends there."""
        suffix, places = self.states[state]
        text = suffix + bytes((byte,))
        token, count = None, None
        for i in range(len(text)):  # tokens that end here, the longest first
            part = text[i:]
            if part in self.tokens:
                before, last = places[i]
                if (self.follows(last, part) if last else self.alone(part)):
                    token, count = part, before + 1
                    break
        if token is None:
            raise ValueError("the vocabulary lacks single bytes")
        now = [*places, (count, token)]
        while text and text not in self.prefixes:
            text, now = text[1:], now[1:]
        # only places from which a token may still grow matter
        key = (text, tuple(self._one((p[0] - count, p[1])) if text[i:] in self.prefixes or i == len(text) else None for i, p in enumerate(now)))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            if number >= len(self.table):
                self.table = np.concatenate((self.table, np.full((len(self.table) // 2, 256), -1, np.int32)))
                self.visits = np.concatenate((self.visits, np.zeros(len(self.table) - len(self.visits), np.int64)))
        self.table[state, byte] = number | (count + 64) << 24

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        long = np.flatnonzero(ends - starts > 2 * CHUNK)
        if not len(long):
            return self._run(data, starts, ends, np.zeros(len(starts), np.int64))[0]
        short = np.flatnonzero(ends - starts <= 2 * CHUNK)
        out = np.zeros(len(starts), np.int64)
        out[short] = self._run(data, starts[short], ends[short], np.zeros(len(short), np.int64))[0]
        for i in long.tolist():
            out[i] = self._chunked(data, int(starts[i]), int(ends[i]))
        return out

    def _chunked(self, data: np.ndarray, start: int, end: int) -> int:
        """Tokens of one long piece."""
        total, now = 0, 0  # the state in which the last chunk ended
        for a in range(start, end, CHUNK * 1024):
            begin = np.arange(a, min(a + CHUNK * 1024, end), CHUNK)
            first = self._run(data, np.maximum(begin - WARM, start), begin, np.zeros(len(begin), np.int64))[1]
            emitted, last = self._run(data, begin, np.minimum(begin + CHUNK, end), first)
            named = [self.states[q] for q in first.tolist()], [self.states[q] for q in last.tolist()]
            for k, (suggested, ended) in enumerate(zip(*named, strict=True)):
                if suggested == self.states[now]:
                    total += int(emitted[k])
                    now = self.numbers[ended]
                else:
                    again, state = self._run(data, begin[k : k + 1], np.minimum(begin[k : k + 1] + CHUNK, end), np.array([now]))
                    total, now = total + int(again[0]), int(state[0])
        return total

    def _run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens emitted, last state) of each run of bytes from its first state; all step together, the longest stay
        to the end."""
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        at, left = starts[order], np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))), "left")
        state, total = first[order], np.zeros(len(at), np.int64)
        for k, n in enumerate(left.tolist()):
            byte, now = data[at[:n] + k], state[:n]
            move = self.table[now, byte]
            new = np.flatnonzero(move < 0)
            if len(new):
                for pair in np.unique(now[new] << 8 | byte[new]).tolist():
                    self.compile(pair >> 8, pair & 255)
                move[new] = self.table[now[new], byte[new]]
            state[:n] = move & 0xFFFFFF
            total[:n] += (move >> 24) - 64
            np.add.at(self.visits, state[:n], 1)
        out, last = np.empty_like(total), np.empty_like(state)
        out[order], last[order] = total, state
        return out, last


class TokenCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or spec["normalizer"] or model["type"] != "BPE" or model["ignore_merges"]:
            raise ValueError("only byte-level BPE files can be compiled")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that reach over white space are not supported")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        raw = lambda t: bytes(map(byte.__getitem__, t))
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        tokens = {raw(t): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = MergeTransducer(tokens, {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)})
        self.seen, self.outputs = PieceCache(), np.zeros(1 << 12, np.int32)

    def _piece_counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What the transducer emits over each piece; a piece that came before isn't run again."""
        view, sizes = eights(data), ends - starts
        keys = byte_hashes(data, starts, ends, view=view)
        keys[keys == 0] = 1
        if self.seen.known.count > MAX_PIECES:
            self.seen, kept = self.seen.halve()
            self.outputs = self.outputs[kept]
        if len(self.merges.states) > MAX_STATES:
            self.merges.halve()
        number = self.seen.find(keys, view, starts, sizes)
        new = np.flatnonzero(number == -1)
        if len(new):
            distinct, sample = np.unique(keys[new], return_index=True)
            one, first = new[sample], self.seen.known.count
            while len(self.outputs) < first + len(distinct):
                self.outputs = np.concatenate((self.outputs, np.zeros_like(self.outputs)))
            self.outputs[first : first + len(distinct)] = self.merges.counts(data, starts[one], ends[one])
            self.seen.add(distinct, data, starts[one], sizes[one])
            number[new] = self.seen.find(keys[new], view, starts[new], sizes[new])
        out, lone = self.outputs[number].astype(np.int64), np.flatnonzero(number < 0)
        out[lone] = self.merges.counts(data, starts[lone], ends[lone])
        return out

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each row."""
        if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2 or any(b" " in s for s in self.special):
            return self._count(data, offsets)
        # before a space that follows a plain character and goes before another one, a piece begins in every state
        return np.array([sum(int(self._count(data[a:b], np.array([0, b - a]))[0]) for a, b in parts(data, "lone space"))])

    def _count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text = data.tobytes()
        found = []
        for special in self.special:
            at = text.find(special)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right"))
                if at + len(special) <= offsets[row]:
                    found.append((at, at + len(special)))
                at = text.find(special, at + len(special))
        bounds = np.unique(np.concatenate((offsets, np.array(found, np.int64).reshape(-1)))) if found else offsets
        starts = piece_starts(data, bounds)
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        if found:
            marks = np.array(sorted(found), np.int64)
            inside = np.searchsorted(marks[:, 0], starts, "right") - 1
            starts = starts[(inside < 0) | (starts >= marks[inside, 1])]
        ends = np.append(starts[1:], len(data))
        limit = bounds[np.searchsorted(bounds, starts, "right")]
        counts = np.concatenate(([0], np.cumsum(self._piece_counts(data, starts, np.minimum(ends, limit)))))
        out = np.diff(counts[np.searchsorted(starts, offsets)])
        if found:
            np.add.at(out, np.searchsorted(offsets, marks[:, 0], "right") - 1, 1)
        return out


@cache
def counter(path: str) -> TokenCounter:
    """One per worker process: what it has compiled serves later tasks."""
    return TokenCounter(path)


def count_tokens(documents: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; rows and their doc_id are kept as they are."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = counter(tokenizer)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                n = it.count(data, offsets)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[a:b], "n_bytes": np.diff(offsets), "n_tokens": n, "over_limit": n > limit})

    return documents.select("doc_id", "text").transform(map_arrow, counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
