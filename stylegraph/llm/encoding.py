"""Token ids of whole texts from a tokenizers file, in bounded groups.

A byte-level BPE encodes the parts of its splitting pattern one by one, so the ids of
a text are the ids of its parts in a row. The library encodes each part once per
worker; texts with characters beyond the plain Latin letters, or with a
special token, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters encoded at a time, and parts remembered by a worker.
GROUP, REMEMBERED = 1_000_000, 800_000

_letters = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Outside these characters the classes of two pattern libraries might differ.
_beyond = re.compile(f"[^\\t\\n\\r -~{_letters}]").search
#: The public splitting pattern of byte-level BPE over those characters.
_parts = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_letters}]+| ?[0-9]+| ?[^\\s0-9{_letters}]+|\\s+(?!\\S)|\\s+").findall


class Encoder:
    """A tokenizer without truncation and padding, and the parts it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # the cores belong to Spark's tasks
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        spec = json.loads(self.model.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.by_parts = (spec["model"]["type"] == "BPE" and not spec.get("normalizer")
                         and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                         and not split.get("add_prefix_space", True))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.known: dict[str, bytes] = {}

    def raw(self, texts: list[str]) -> list[bytes]:
        rows = [array("I", e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]
        if sys.byteorder == "big":
            for row in rows:
                row.byteswap()
        return [row.tobytes() for row in rows]

    def __call__(self, texts: list[str], remembered: int = REMEMBERED) -> list[bytes]:
        """Ids of whole texts as little-endian uint32; beyond ``remembered`` parts the known ones are dropped."""
        out: list[bytes | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts)
                 if not self.by_parts or _beyond(t) or any(s in t for s in self.special)]
        for i, ids in zip(whole, self.raw([texts[i] for i in whole])):
            out[i] = ids
        known = self.known
        if len(known) > remembered:
            known.clear()
        parts = {i: _parts(t) for i, t in enumerate(texts) if out[i] is None}
        missing = list(set().union(*parts.values()).difference(known))
        known.update(zip(missing, self.raw(missing)))
        for i, found in parts.items():
            out[i] = b"".join(map(known.__getitem__, found))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(column: pa.Array, path: str, end_id: int, remembered: int = REMEMBERED) -> Iterator[np.ndarray]:
    """Ids of each text (null as empty) with ``end_id`` behind, as little-endian uint32."""
    end = np.array([end_id], "<u4").tobytes()

    def flush(texts: list[str]) -> Iterator[np.ndarray]:
        for ids in encoder(path)(texts, remembered):
            yield np.frombuffer(ids + end, "<u4")

    texts, size = [], 0
    for value in column:
        texts.append(value.as_py() or "")
        size += len(texts[-1])
        if size >= GROUP:
            yield from flush(texts)
            texts, size = [], 0
    yield from flush(texts)
