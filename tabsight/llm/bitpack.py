"""Token ids in files of fixed-width bits, with block offsets for random access.

A file: the mark ``TIDB0001``; the blocks, each of ``block`` ids (the last has fewer)
packed with ``bits`` bits an id, lowest bit first, from a whole byte on; the byte offset of
each block; the first id of each document and the end of the last; the document ids; a
byte each for documents without id; then the footer: bits, block, ids, documents, and where
the offsets begin, as little-endian 64-bit integers, and the mark again.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .common import tasks_of, texts
from .tokens import bits_for, encoded, encoder

MARK = b"TIDB0001"
FOOTER = "<qqqqq"
FOOTER_BYTES = struct.calcsize(FOOTER)
BLOCK = 4096
# Blocks that a sequential reader unpacks at once.
READ_BLOCKS = 256
MANIFEST = "part int, path string, n_docs long, n_ids long"


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if bits % 8 == 0:
        return ids.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    spread = (ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits % 8 == 0:
        out = np.zeros((n, 4), np.uint8)
        out[:, : bits // 8] = np.frombuffer(data, np.uint8, n * bits // 8).reshape(n, -1)
        return out.view("<u4").reshape(-1)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that the cluster's own file system settings give it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else uri.replace("file:", "", 1))


class Writer:
    """Writes a file as documents come; keeps one open block and a few bytes a document."""

    def __init__(self, out, bits: int, block: int):
        self.out, self.bits, self.block = out, bits, block
        self.at, self.offsets, self.starts, self.doc_ids, self.missing = 0, [], [], [], []
        self.rest, self.n = np.zeros(0, "<u4"), 0
        self._put(MARK)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: list, begins: np.ndarray, ids: np.ndarray) -> None:
        """Documents in a row: their ids, and where each one's ids begin."""
        self.starts.append(begins.astype("<i8") + self.n)
        self.doc_ids += [d or 0 for d in doc_ids]
        self.missing += [d is None for d in doc_ids]
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // self.block * self.block
        for at in range(0, whole, self.block):
            self.offsets.append(self.at)
            self._put(pack(ids[at : at + self.block], self.bits))
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self.offsets.append(self.at)
            self._put(pack(self.rest, self.bits))
        tail = self.at
        self._put(np.array(self.offsets, "<i8").tobytes())
        self._put(np.concatenate([*self.starts, [self.n]]).astype("<i8").tobytes())
        self._put(np.array(self.doc_ids, "<i8").tobytes())
        self._put(np.array(self.missing, np.uint8).tobytes())
        self._put(struct.pack(FOOTER, self.bits, self.block, self.n, len(self.doc_ids), tail) + MARK)
        self.out.close()


class Reader:
    """Random access to the ids and documents of a file."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        end = self.file.read_at(FOOTER_BYTES + len(MARK), size - FOOTER_BYTES - len(MARK))
        if end[-len(MARK) :] != MARK:
            raise ValueError(f"{uri} is cut short")
        self.bits, self.block, self.n, self.n_docs, tail = struct.unpack(FOOTER, end[: FOOTER_BYTES])
        index = self.file.read_at(size - tail, tail)
        blocks = -(-self.n // self.block)
        self.offsets = np.append(np.frombuffer(index, "<i8", blocks), tail)
        self.starts = np.frombuffer(index, "<i8", self.n_docs + 1, 8 * blocks)
        self.doc_ids = np.frombuffer(index, "<i8", self.n_docs, 8 * (blocks + self.n_docs + 1))
        self.missing = np.frombuffer(index, np.uint8, self.n_docs, 8 * (blocks + 2 * self.n_docs + 1)).astype(bool)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to before stop, reading the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        base, parts = int(self.offsets[first]), []
        for b in range(first, last + 1):
            n = min(self.block, self.n - b * self.block)
            parts.append(unpack(data[int(self.offsets[b]) - base : int(self.offsets[b + 1]) - base], self.bits, n))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def checksums(self) -> np.ndarray:
        """The crc32 of each document's ids, some blocks at a time."""
        out, step = np.zeros(self.n_docs, np.int64), self.block * READ_BLOCKS
        doc = 0
        for at in range(0, self.n, step):
            data = memoryview(self.ids(at, min(self.n, at + step)).astype("<u4").tobytes())
            stop = at + len(data) // 4
            while doc < self.n_docs and self.starts[doc] < stop:
                a, b = max(at, int(self.starts[doc])), min(stop, int(self.starts[doc + 1]))
                out[doc] = zlib.crc32(data[4 * (a - at) : 4 * (b - at)], int(out[doc]))
                if self.starts[doc + 1] > stop:
                    break
                doc += 1
        return out


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, block: int = BLOCK) -> DataFrame:
    """Encode whole texts and write their ids in ascending doc_id order; returns the
    manifest (part, path, n_docs, n_ids), whose parts are in that order.

    The documents are range-partitioned by id (and, where one id has many rows, by a hash
    of the text), each task encodes its own and streams them into one file. A file
    belongs to the result only if the manifest names it, so a repeated task does no harm.
    Null text is empty, null ids come first, rows with equal ids follow each other,
    an empty table gives no files.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder or scratch_path(spark, "tokens"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, path = TaskContext.get().partitionId(), None, f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tid"
        bits = bits_for(encoder(tokenizer).vocabulary)
        for rows, ids, begins in encoded(batches, tokenizer):
            if writer is None:
                system, local = opened(path)
                system.create_dir(local.rsplit("/", 1)[0], recursive=True)
                writer = Writer(system.open_output_stream(local), bits, block)
            ends = np.insert(ids, begins[1:], end_id)
            writer.add(rows.column(0).to_pylist(), begins[:-1] + np.arange(len(begins) - 1), ends)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "path": [path], "n_docs": [len(writer.doc_ids)], "n_ids": [writer.n]}
            )

    salted = texts(docs).withColumn("salt", F.xxhash64("text"))
    ordered = salted.repartitionByRange("doc_id", "salt").sortWithinPartitions("doc_id", "salt", "text")
    return materialise(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32. One task reads a file, some blocks at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = Reader(path)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(r.doc_ids, mask=r.missing),
                        "start": pa.array(r.starts[:-1] + base),
                        "n_tokens": pa.array(np.diff(r.starts)),
                        "ids_crc32": pa.array(r.checksums()),
                    }
                )

    # One row per file: small, however much the files hold.
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"))
    dealt = based.repartition(tasks_of(manifest.sparkSession))
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
