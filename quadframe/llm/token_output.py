"""Token ids as Arrow files of fixed-size-list batches, and their reader.

Documents are range-partitioned and sorted by id; each task encodes its range and streams it to one Arrow
IPC file in the shared folder: record batches with `ids` and `mask`, both fixed-size lists of `sequence`
entries, the last sequence padded under a zero mask. Equal-length batches make every sequence addressable
by arithmetic, and a memory-mapped file serves it without a copy. A file appears under its final name only
when complete, so a lost task leaves nothing half written and its repetition writes the same bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

SEQUENCE = 2048
BATCH_SEQUENCES = 256
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"


def file_schema(sequence: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("ids", pa.list_(id_type, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class Writer:
    """Appends ids to one file, a full batch at a time."""

    def __init__(self, uri: str, sequence: int = SEQUENCE, batch_sequences: int = BATCH_SEQUENCES, id_bits: int = 16):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.sequence, self.full, self.held, self.n = sequence, sequence * batch_sequences, np.empty(0, np.uint32), 0
        self.id_type = pa.uint16() if id_bits == 16 else pa.uint32()
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.sink = self.fs.open_output_stream(self.part)
        self.schema = file_schema(sequence, self.id_type)
        self.file = pa.ipc.new_file(self.sink, self.schema)

    def _flush(self, ids: np.ndarray, size: int) -> None:
        """Write a batch of size ids, filled up under a zero mask."""
        padded = np.zeros(size, self.id_type.to_pandas_dtype())
        padded[: len(ids)] = ids
        columns = (pa.array(padded), pa.array(np.arange(size) < len(ids)))
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(c, type=f.type) for c, f in zip(columns, self.schema)], schema=self.schema))

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        ids = np.concatenate([self.held, ids])
        whole = len(ids) - len(ids) % self.full
        for i in range(0, whole, self.full):
            self._flush(ids[i : i + self.full], self.full)
        self.held = ids[whole:].copy()

    def close(self) -> None:
        if len(self.held):
            self._flush(self.held, -(-len(self.held) // self.sequence) * self.sequence)
        self.file.close()
        self.sink.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Random access to a file's sequences and token ranges; local files are memory-mapped."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.sequence = self.file.schema.field("ids").type.list_size
        self.batch_rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0

    def _values(self, column: str, k: int) -> pa.Array:
        return self.file.get_batch(k).column(self.file.schema.get_field_index(column)).values

    def sequence_at(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i, without a copy."""
        k, at = divmod(i, self.batch_rows)
        ids = self._values("ids", k).to_numpy(zero_copy_only=True)[at * self.sequence : (at + 1) * self.sequence]
        return ids, self._values("mask", k).slice(at * self.sequence, self.sequence)

    def crc32(self, start: int, n: int) -> int:
        """crc32 of ids start .. start + n - 1 as little-endian 32-bit integers."""
        size, crc = self.batch_rows * self.sequence, 0
        while n > 0:
            k, at = divmod(start, size)
            take = min(n, size - at)
            ids = self._values("ids", k).to_numpy(zero_copy_only=True)[at : at + take]
            crc = zlib.crc32(ids.astype("<u4"), crc)
            start, n = start + take, n - take
        return crc


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files into folder (a URI all executors share); returns the index: doc_id, file, at (first
    id's place in the file), n_tokens, in file order. Rows of one id lie in order of their text's hash."""
    vocabulary = vocabulary or tokens.public_path(VOCABULARY)
    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, out = tokens.encoder(vocabulary), TaskContext.get().partitionId(), None
        bits = 16 if max(encoder.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 32
        for b in batches:
            at = 0
            for ids, ends in encoder.encode(b.column(1), end_id):
                out = out or Writer(f"{folder}/{task:06d}.arrow", sequence, id_bits=bits)
                begin = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ends)), pa.array(np.full(len(ends), task, np.int32)), pa.array(out.n + begin), pa.array(ends - begin)], schema=schema)
                out.add(ids)
                at += len(ends)
        if out:
            out.close()

    common.ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return common.stage(ordered.mapInArrow(run, "doc_id long, file int, at long, n_tokens long"), "tokenindex")


def encode_and_read(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes docs and returns per row, from the files: doc_id, start, n_tokens, ids_crc32.

    A null or empty text is the end id alone; a null doc_id comes first; repeated rows are written each;
    an empty table writes no file. Other columns are not read. Only one row per file is ever gathered.
    """
    folder = folder or common.new_path(docs.sparkSession, "tokens")
    index = write(docs, folder, **options)
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = index.join(totals.select("file", before.alias("before")), "file")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for b in batches:
            crc = []
            for file, at, n in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
                if file != name:
                    name, reader = file, Reader(f"{folder}/{file:06d}.arrow")
                crc.append(reader.crc32(at, n))
            start = pa.compute.add(b.column(2), b.column(4))
            yield pa.RecordBatch.from_arrays([b.column(0), start, b.column(3), pa.array(crc, pa.int64())], schema=schema)

    return placed.select("doc_id", "file", "at", "n_tokens", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
