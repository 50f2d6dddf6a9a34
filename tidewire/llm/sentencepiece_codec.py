"""Operator 7: SentencePiece encoding that keeps offsets, and decoding.

A text is normalised first: at each place the longest prefix in the model's compiled character map (a double-array
trie) is replaced, or else one character is kept; every normalised byte records the source byte that it stems from.
Pieces cover the normalised text, so the alignment projects each piece to a span of bytes of the source.

Without a character map, and where no piece of the vocabulary goes on over a space, texts are cut before spaces and
each distinct piece of text goes through the library once (see chunks.py); else whole normalised texts go.

Null texts are empty and have the end id alone. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.common import map_arrow
from tidewire.llm.chunks import PieceEncoder, _flat
from tidewire.llm.textscan import slices

SPACE = "▁".encode()


class CharacterMap:
    """The compiled character map: a trie of source strings that lead to strings in a pool."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, replacement) of the longest source string that begins at `at`."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if (unit >> 8) & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        return found and (found[0], self.pool[found[1] : self.pool.index(b"\0", found[1])])


class Normalizer:
    def __init__(self, charsmap: bytes, dummy_prefix: bool, collapse: bool, escape: bool):
        self.map, self.dummy_prefix, self.collapse = CharacterMap(charsmap), dummy_prefix, collapse
        self.space = SPACE if escape else b" "

    def normalize(self, text: bytes) -> tuple[bytes, list[int]]:
        """(normalised text, source offset of each of its bytes and of its end)."""
        steps, at = [], 0
        while at < len(text):
            hit = self.map.longest(text, at)
            if hit is None:
                lead = text[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = size, text[at : at + size]
            steps.append((at, *hit))
            at += hit[0]
        out, align, end = bytearray(), [], len(text)
        if self.collapse:
            while steps and steps[0][2] == b" ":
                steps.pop(0)
        if not steps:
            return b"", [end]
        if self.dummy_prefix:
            out += self.space
            align += [steps[0][0]] * len(self.space)
        blank = self.collapse
        for start, _, new in steps:
            if self.collapse and blank:
                new = new.lstrip(b" ")
            for byte in new:
                part = self.space if byte == 0x20 else bytes((byte,))
                out += part
                align += [start] * len(part)
            if new:
                blank = new.endswith(b" ")
        if self.collapse:
            while out.endswith(self.space):
                del out[-len(self.space) :]
                end = align[-len(self.space)]
                del align[-len(self.space) :]
        return bytes(out), [*align, end]


class Codec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            raw = f.read()
        proto = sentencepiece_model_pb2.ModelProto.FromString(raw)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec = proto.normalizer_spec
        self.end_id = self.library.eos_id()
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.sizes = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        over = any(re.search("[^▁]▁", p.piece) for p in proto.pieces if p.type in (p.NORMAL, p.USER_DEFINED))
        special = any(p.type == p.USER_DEFINED for p in proto.pieces)
        plain = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
        has_bytes = any(p.type == p.BYTE for p in proto.pieces)
        self.cut = plain and has_bytes and not (spec.precompiled_charsmap or over or special or proto.trainer_spec.treat_whitespace_as_suffix)
        self.pieces = PieceEncoder(self._encode, "spaces", lambda piece, begins: piece if begins else piece[1:])
        self.decimal = [str(i).encode() for i in range(len(proto.pieces))]

    def _encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # a lone space beside the prefix: the library would take an empty text for nothing
        lone = [self.library.piece_to_id("▁")]
        return _flat([ids or lone for ids in self.library.encode([t.decode() for t in texts], num_threads=1)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids without end id, number of ids of each row, first source byte of each id in its row, end byte)."""
        if self.cut:
            ids, counts = self.pieces.encode(data, offsets)
            # normalised length up to each source byte: a space becomes three bytes, a filled row begins with three more
            sizes = np.where(data == 0x20, 3, 1)
            rows = np.flatnonzero(np.diff(offsets))
            ahead = np.zeros(len(data) + 1, np.int64)
            ahead[offsets[rows]] = 3
            place = np.cumsum(np.concatenate(([0], sizes)) + ahead)
            ends = np.cumsum(self.sizes[ids])
            owner = np.repeat(np.arange(len(counts)), counts)
            begin = np.searchsorted(place, ends - self.sizes[ids], "right") - 1
            begin, end = np.maximum(begin, offsets[owner]), np.searchsorted(place[:-1] + sizes, ends, "right")
            return ids, counts, begin - offsets[owner], end - offsets[owner]
        all_ids, counts, begins, ends = [], [], [], []
        raw = data.tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            _, align = self.normalizer.normalize(raw[a:b])
            ids = np.array(self.library.encode(raw[a:b].decode()), np.int64)
            sizes = self.sizes[ids]
            if (unknown := ids == self.library.unk_id()).any():  # such a piece is as long as what it stands for
                names = self.library.encode(raw[a:b].decode(), out_type=str)
                sizes[unknown] = [len(names[i].encode()) for i in np.flatnonzero(unknown)]
            at = np.concatenate(([0], np.cumsum(sizes)))
            align = np.array(align, np.int64)
            at = np.minimum(at, len(align) - 1)
            all_ids.append(ids)
            counts.append(len(ids))
            begins.append(align[at[:-1]])
            ends.append(align[at[1:]])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(none + all_ids), np.array(counts, np.int64), np.concatenate(none + begins), np.concatenate(none + ends)


@cache
def codec(path: str) -> Codec:
    """One per worker process: its cache of pieces serves later tasks."""
    return Codec(path)


def encode_documents(documents: DataFrame, model: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, n_bytes, covered_bytes (bytes of the source that pieces cover) and
    - ids, begins, ends: arrays with the end id last, whose span is empty; or with digests
    - ids_sha256, decoded_sha256: of the decimal ids joined by spaces, and of decode(ids)."""
    more = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, begins array<int>, ends array<int>"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = codec(model)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                ids, counts, begins, ends = it.encode(data, offsets)
                bounds = np.concatenate(([0], np.cumsum(counts)))
                covered = np.concatenate(([0], np.cumsum(ends - begins)))[bounds]
                out = {"doc_id": batch.column("doc_id")[a:b], "n_tokens": counts + 1, "n_bytes": np.diff(offsets), "covered_bytes": np.diff(covered)}
                if digests:
                    lists = [x.tolist() for x in np.split(ids, bounds[1:-1])]
                    text = it.decimal
                    out["ids_sha256"] = [hashlib.sha256(b" ".join([*map(text.__getitem__, x), text[it.end_id]])).hexdigest() for x in lists]
                    out["decoded_sha256"] = [hashlib.sha256(it.library.decode([*x, it.end_id]).encode()).hexdigest() for x in lists]
                else:
                    at, size = bounds[1:], np.diff(offsets)
                    for name, values, last in (("ids", ids, it.end_id), ("begins", begins, size), ("ends", ends, size)):
                        flat = pa.array(np.insert(values.astype(np.int64), at, last).astype(np.int32))
                        out[name] = pa.ListArray.from_arrays(pa.array((bounds + np.arange(len(bounds))).astype(np.int32)), flat)
                yield pa.RecordBatch.from_pydict(out)

    return documents.select("doc_id", "text").transform(map_arrow, encoded, f"doc_id long, n_tokens long, n_bytes long, covered_bytes long, {more}")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give null."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = codec(model)
        for batch in batches:
            texts = [None if x is None else it.library.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").transform(map_arrow, decoded, "doc_id long, text string")
