"""SentencePiece ids and texts by way of a table of distinct marked words.

Where no piece holds a space mark behind another character, nor a line break, a text
falls into chunks (a run of marks with the word behind it, or a line break) that no
piece crosses. A worker keeps a table of the chunks it has met: each distinct one is
segmented once, and the ids of a text are the entries of its chunks in order.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stylegraph.llm.common import groups, only

SPACE = "▁"
#: Characters worked on at a time, chunks a worker remembers, and the longest it remembers.
GROUP, REMEMBERED, LONGEST = 1_000_000, 500_000, 48
_chunks = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall


class ChunkTable:
    """The chunks a worker has met, with their ids as little-endian int32."""

    def __init__(self, model_file: str):
        import sentencepiece
        model = self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p, odd in zip(pieces, special) if not odd):
            raise ValueError("pieces must not reach over the start of a word or a line")
        if sum(model.is_byte(i) for i in range(size)) != 256:
            raise ValueError("the model needs a byte for every character it has no piece for")
        probe = " a  b" + "".join(map(chr, range(32, 0x3200))) + "  "
        if model.normalize(probe) != (SPACE + probe).replace(" ", SPACE):
            raise ValueError("the model must add one mark in front and change nothing else")
        # what decoding makes of each id; None where the library must see the neighbours
        self.bytes: list[bytes | None] = [
            None if model.is_control(i) or model.is_unknown(i) else
            bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(pieces)]
        self.marked = [not odd and p.startswith(SPACE) for p, odd in zip(pieces, special)]
        self.known: dict[str, bytes] = {}
        self.segmented = 0

    def segment(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. The library puts a mark in front of every text: it stands for the first mark of
        a chunk, and for chunks without one a line break keeps it off."""
        marked = [c[0] == SPACE for c in chunks]
        found = self.model.encode([c[1:] if m else "\n" + c for c, m in zip(chunks, marked)],
                                  add_bos=False, add_eos=False, enable_sampling=False, num_threads=1)
        self.segmented += len(chunks)
        return [np.array(ids if m else ids[2:], "<i4").tobytes() for ids, m in zip(found, marked)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian int32."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        split = [_chunks(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        fresh = list(dict.fromkeys(c for chunks in split for c in chunks if c not in known))
        # a single mark has an empty rest, which the library encodes as nothing
        known.update(zip(fresh, self.segment(fresh)))
        if SPACE in known and not known[SPACE]:
            known[SPACE] = np.array([self.model.piece_to_id(SPACE)], "<i4").tobytes()
        out = [b"".join([known[c] for c in chunks]) for chunks in split]
        for c in fresh:                      # long chunks are rare; remembering them costs too much
            if len(c) > LONGEST:
                del known[c]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids as the library gives it."""
        listed = ids.tolist()
        if not listed:
            return ""
        table = self.bytes
        parts = [table[i] for i in listed]
        if None in parts or not self.marked[listed[0]]:
            return self.model.decode(listed)
        try:
            return b"".join(parts)[1:].decode()
        except UnicodeDecodeError:           # bytes that are no characters
            return self.model.decode(listed)


_tables: dict[str, ChunkTable] = {}


def chunk_table(model_file: str) -> ChunkTable:
    """One table per worker and model."""
    if model_file not in _tables:
        _tables[model_file] = ChunkTable(model_file)
    return _tables[model_file]


def encode_pieces(docs: DataFrame, model_file: str) -> DataFrame:
    """Ids of whole texts of ``docs(doc_id, text)`` as ``(doc_id, ids array<int>)``, as the library gives them.

    No ids are added in front or behind, nothing is sampled. A null text is empty and has
    no ids; texts of any length are encoded whole. Null and repeated ids and repeated rows
    stay rows of their own; no rows give no rows. A model whose pieces cross marks, or that
    normalises texts, is refused.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_file)
        for batch in batches:
            at = 0
            for texts in groups(batch.column("text"), GROUP):
                gc.disable()                 # nothing here makes cycles, and the table is large
                coded = table.encode(texts)
                gc.enable()
                ends = np.cumsum([0] + [len(c) // 4 for c in coded], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(coded), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.ListArray.from_arrays(pa.array(ends), flat)], schema=schema)
                at += len(texts)

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_pieces(encoded: DataFrame, model_file: str) -> DataFrame:
    """``(doc_id, ids, text)``: the text that the library's ``decode`` makes of ``encoded(doc_id, ids)``.

    Null ids count as none and give an empty text; ids outside the vocabulary are an error.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_file)
        for batch in batches:
            ids = batch.column("ids")
            # a slice may share the values of a larger array
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum(
                [0, *ids.value_lengths().fill_null(0).to_pylist()])
            texts = [table.decode(flat[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())], schema=schema)

    return only(encoded, doc_id="bigint", ids="array<int>").mapInArrow(run, "doc_id bigint, ids array<int>, text string")
