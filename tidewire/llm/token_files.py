"""Operator 1: token ids in Arrow stream files of equal-length sequences.

Documents are dealt by ranges of doc_id and sorted, so the partitions in their order hold the documents in ascending
order. Each task encodes its documents and writes one shard of two Arrow stream files:

- `*-ids.arrow`: one record batch per 1024 sequences, of columns `ids` (fixed-size list of unsigned integers, 16 bits
  where the vocabulary allows, else 32) and `mask` (fixed-size list of booleans, false for the padding that fills
  the shard's last sequence). Lists of fixed size have no offsets, so a memory-mapped file is one flat array of ids
  in each batch: TokenFile gives sequence i and its mask's bits as views of the file's memory, without copying.
- `*-documents.arrow`: doc_id, start (ids of the shard before it), n_tokens.

Shards whose task ran twice are told apart by the task attempt in their names; the manifest names those that count.
Null texts are empty; equal doc_ids stand in an order given by their texts; rows without doc_id come first. An empty
table gives no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.chunks import json_tokenizer, largest_id
from tidewire.llm.common import map_arrow, shared_folder, text_of, written
from tidewire.llm.textscan import slices

SEQUENCE_LENGTH = 2048
_BATCH = 1024

MANIFEST = "shard long, ids_path string, documents_path string, n_documents long, n_tokens long, n_sequences long"


class _SequenceFile:
    """Takes ids one after another and writes them as batches of sequences."""

    def __init__(self, sink, length: int, kind: pa.DataType):
        self.length, self.kind, self.sequences, self.rest = length, kind, 0, []
        self.held = 0
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_stream(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= self.length * _BATCH:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        step = self.length * _BATCH
        whole = len(ids) if last else len(ids) - len(ids) % step
        for a in range(0, whole, step):
            part = ids[a : min(a + step, whole)].astype(self.kind.to_pandas_dtype())
            n = -(-len(part) // self.length)
            mask = np.arange(n * self.length) < len(part)
            part = np.concatenate((part, np.zeros(n * self.length - len(part), part.dtype)))
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (part, mask)]
            self.writer.write_batch(pa.record_batch(arrays, schema=self.schema))
            self.sequences += n
        self.rest = [ids[whole:]]
        self.held = len(self.rest[0])

    def close(self) -> None:
        self._write(True)
        self.writer.close()


def _open(path: str, mode: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        return store.open_output_stream(inner)
    local = isinstance(store, fs.LocalFileSystem)
    return pa.memory_map(inner) if local else store.open_input_file(inner)


def write_token_files(documents: DataFrame, tokenizer: str, folder: str, end_id: int, sequence_length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Encodes and writes all documents; gives the manifest, one row per shard, in the order of doc_id.

    tokenizer: path of a tokenizers file; folder: where the shards go, any place pyarrow's file systems reach.
    """
    if sequence_length % 8:
        raise ValueError("the sequence length must be a multiple of eight")
    kind = pa.uint16() if max(largest_id(tokenizer), end_id) < 1 << 16 else pa.uint32()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, file, encoder, rows, total = TaskContext.get(), None, json_tokenizer(tokenizer), [], 0
        at = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                if file is None:
                    sink = _open(f"{at}-ids.arrow", "w")
                    file = _SequenceFile(sink, sequence_length, kind)
                ids, counts = encoder.encode(data, offsets)
                ends = np.cumsum(counts)
                file.add(np.insert(ids, ends, end_id))
                counts = counts + 1
                rows.append(pa.table({"doc_id": batch.column("doc_id")[a:b], "start": total + np.cumsum(counts) - counts, "n_tokens": counts}))
                total += int(counts.sum())
        if file is not None:
            file.close()
            sink.close()
            listed = pa.concat_tables(rows)
            with _open(f"{at}-documents.arrow", "w") as out, pa.ipc.new_stream(out, listed.schema) as writer:
                writer.write_table(listed, max_chunksize=1 << 16)
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "ids_path": [f"{at}-ids.arrow"], "documents_path": [f"{at}-documents.arrow"], "n_documents": [len(listed)], "n_tokens": [total], "n_sequences": [file.sequences]})

    dealt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    dealt = dealt.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(dealt.transform(map_arrow, shard, MANIFEST))


class TokenFile:
    """Random access to the sequences of one shard: each is a view of the memory-mapped file."""

    def __init__(self, ids_path: str):
        self.batches = list(pa.ipc.open_stream(_open(ids_path, "r")))
        self.starts = np.concatenate(([0], np.cumsum([len(b) for b in self.batches])))

    def __len__(self) -> int:
        return int(self.starts[-1])

    def _of(self, name: str, i: int) -> tuple[pa.Array, int, int]:
        """(all values of the batch that holds sequence i, where it begins there, its length)"""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.starts, i, "right")) - 1
        column = self.batches[k].column(name)
        return column.values, (i - int(self.starts[k])) * column.type.list_size, column.type.list_size

    def sequence(self, i: int) -> np.ndarray:
        values, at, size = self._of("ids", i)
        return values.to_numpy()[at : at + size]

    def mask_bits(self, i: int) -> np.ndarray:
        """The mask as packed bits, the lowest first; sequence lengths are multiples of eight."""
        values, at, size = self._of("mask", i)
        return np.frombuffer(values.buffers()[1], np.uint8)[at // 8 : (at + size) // 8]

    def mask(self, i: int) -> np.ndarray:
        return np.unpackbits(self.mask_bits(i), bitorder="little").view(bool)


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files.

    The manifest has a row per shard; its token counts are summed up on the driver.
    """
    shards = manifest.orderBy("shard").collect()
    starts = np.concatenate(([0], np.cumsum([s.n_tokens for s in shards]))).tolist()
    spark = manifest.sparkSession
    listed = spark.createDataFrame([(s.ids_path, s.documents_path, starts[i]) for i, s in enumerate(shards)], "ids_path string, documents_path string, base long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stream = iter(pa.ipc.open_stream(_open(row["ids_path"], "r")))
                held, first = np.zeros(0, np.uint32), 0
                for part in pa.ipc.open_stream(_open(row["documents_path"], "r")):
                    start, size = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    crcs = []
                    for s, n in zip(start.tolist(), size.tolist(), strict=True):
                        while first + len(held) < s + n:
                            block = next(stream)
                            ids = block.column("ids").flatten().to_numpy()
                            valid = block.column("mask").values.to_numpy(zero_copy_only=False)
                            held, first = np.concatenate((held[s - first :], ids[valid].astype("<u4"))), s
                        crcs.append(zlib.crc32(held[s - first : s - first + n].tobytes()))
                    yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "start": start + row["base"], "n_tokens": size, "ids_crc32": pa.array(crcs, pa.int64())})

    return listed.repartition(max(1, len(shards))).transform(map_arrow, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes the files and reads them back, a row per document."""
    folder = folder or shared_folder(documents.sparkSession)
    return read_documents(write_token_files(documents, tokenizer, folder, end_id))
