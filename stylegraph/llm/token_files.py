"""Token ids in files of independent zstandard frames with a seek table.

A file holds one frame per document, each with its own checksum; then a skippable
frame with the ids of the documents; then the seek table, a skippable frame in the
public seekable layout: per frame its compressed size, its size and the low half of
its XXH64, then the number of frames, a descriptor byte and a magic number. A
plain zstandard decoder gives the ids of all documents in a row. A reader
fetches the tables at the end and then only the frames of the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stylegraph.llm.common import only
from stylegraph.llm.encoding import encoded
from stylegraph.sources.staging import scratch_root, settle

# Fixed values of the public seekable format.
SKIPPABLE, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Skippable frame with the ids of the documents: n longs, then n bytes telling null ids.
INDEX = 0x184D2A51


class FrameWriter:
    """Writes frames to a file and its tables on close."""

    def __init__(self, sink, level: int = 3):
        import zstandard
        self.sink = sink
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True,
                                             write_content_size=True).compress
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.tokens = self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash
        raw = ids.tobytes()
        packed = self.pack(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.tokens += len(ids)
        self.size += len(packed)

    def close(self) -> None:
        n = len(self.frames)
        index = (np.array([i or 0 for i in self.ids], "<i8").tobytes()
                 + np.array([i is None for i in self.ids], "u1").tobytes())
        table = np.array(self.frames, "<u4").tobytes()
        tail = (struct.pack("<II", INDEX, len(index)) + index
                + struct.pack("<II", SKIPPABLE, len(table) + 9) + table
                + struct.pack("<IBI", n, CHECKSUMS, SEEK_MAGIC))
        self.sink.write(tail)
        self.size += len(tail)


class FrameReader:
    """Reads the tables of a file, then any of its frames."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, kind, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEK_MAGIC or kind != CHECKSUMS:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.packed, self.raw, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.starts = np.cumsum(self.packed) - self.packed
        index = source.read_at(9 * n, size - 9 - 12 * n - 8 - 9 * n)
        self.ids = np.frombuffer(index[:8 * n], "<i8")
        self.null = np.frombuffer(index[8 * n:], "u1").astype(bool)

    def frame(self, i: int) -> np.ndarray:
        import xxhash
        import zstandard
        packed = self.source.read_at(int(self.packed[i]), int(self.starts[i]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.raw[i]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} does not match its checksum")
        return np.frombuffer(raw, "<u4")

    def of(self, doc_ids: Sequence[int]) -> list[tuple[int, np.ndarray]]:
        """The documents with these ids; only their frames are read."""
        wanted = np.isin(self.ids, np.asarray(list(doc_ids), dtype=np.int64)) & ~self.null
        return [(int(self.ids[i]), self.frame(int(i))) for i in np.flatnonzero(wanted)]


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0,
                      folder: str | None = None, files: int | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending order of ``doc_id``.

    Returns the manifest, one row per file: ``shard, path, documents, tokens, bytes,
    first_token`` (tokens of all files before it). Null ids come first, a null text
    is empty and holds just the end id, rows that repeat an id are written one after
    the other in the order of their texts' hashes; no rows give an empty manifest.
    ``folder`` is any folder pyarrow can open (default: below ``spark.checkpoint.dir``).
    A task writes under a name of its own and renames the finished file, so a
    repeated task leaves one whole file.
    """
    spark = docs.sparkSession
    folder = folder or f"{scratch_root(spark)}/stylegraph/tokens-{uuid.uuid4().hex}"
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("documents", pa.int64()),
                        ("tokens", pa.int64()), ("bytes", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        final = f"{base}/shard-{shard:06d}.zst"
        attempt = f"{base}/.shard-{shard:06d}-{uuid.uuid4().hex}"
        sink = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(attempt)
                frames = FrameWriter(sink)
            for doc_id, ids in zip(batch.column("doc_id"), encoded(batch.column("text"), tokenizer_path, end_id)):
                frames.add(doc_id.as_py(), ids)
        if sink is not None:
            frames.close()
            sink.close()
            store.move(attempt, final)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip((shard, f"{folder.rstrip('/')}/shard-{shard:06d}.zst",
                                                   len(frames.ids), frames.tokens, frames.size),
                                                  schema.types)], schema=schema)

    ordered = (only(docs, doc_id="bigint", text="string").withColumn("_tie", F.xxhash64("text"))
               .repartitionByRange(files, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie"))
    manifest = settle(ordered.select("doc_id", "text").mapInArrow(
        write, "shard int, path string, documents bigint, tokens bigint, bytes bigint"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    return manifest.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """Documents of the files: ``doc_id, start, n_tokens, ids`` (little-endian uint32).

    ``start`` counts the ids of all documents before. With ``doc_ids``, a short list,
    only their frames are fetched and decompressed.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first_token").to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    reader = FrameReader(source)
                    lengths = reader.raw // 4
                    starts = first + np.cumsum(lengths) - lengths
                    wanted = np.arange(len(lengths)) if doc_ids is None else np.flatnonzero(
                        np.isin(reader.ids, np.asarray(list(doc_ids), np.int64)) & ~reader.null)
                    heavy = np.cumsum(lengths[wanted]) // 1_000_000      # about 4 MB of ids a batch
                    for part in np.split(wanted, np.flatnonzero(np.diff(heavy)) + 1):
                        yield pa.RecordBatch.from_arrays([
                            pa.array([None if reader.null[i] else int(reader.ids[i]) for i in part], pa.int64()),
                            pa.array(starts[part], pa.int64()), pa.array(lengths[part], pa.int64()),
                            pa.array([reader.frame(int(i)).tobytes() for i in part], pa.binary())],
                            schema=schema)

    files = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (manifest.select("shard", "path", "first_token").repartitionByRange(files, "shard")
            .mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids binary"))
