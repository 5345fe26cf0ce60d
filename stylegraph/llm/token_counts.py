"""Exact token counts at every prefix of a text, without encoding the prefixes.

In byte-pair encoding a sequence of tokens is the encoding of its text exactly when
each two neighbours are the encoding of their own concatenation. So the encoding of
a prefix ends in the one token that fits behind the encoding of what comes before
it, and ``count[i] = count[i - len(token)] + 1`` runs through the text once.
"""

from __future__ import annotations

import gc
import re
import string
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stylegraph.llm.common import groups, only

SPACE = "▁"
#: Segments and words remembered by a worker, and the longest segment it remembers.
REMEMBERED, LONGEST = 400_000, 48
#: Characters worked on at a time.
GROUP = 2_000_000


class PrefixCounter:
    """Prefix counts for one sentencepiece BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(model.get_piece_size())
                 if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.score):
            raise ValueError("pieces must not reach over the start of a word or a line")
        # the last merge that makes each piece
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[str, bool] = {}
        self.known: dict[str, bytes | list[int]] = {}
        self.words: dict[str, int] = {}
        self.ends = ahocorasick.Automaton()
        for piece in self.score:         # a piece that no merges make never appears
            if len(piece) == 1 or self.halves_of(piece):
                self.ends.add_word(piece, (piece, len(piece)))
        self.ends.make_automaton()
        # no piece reaches over these borders, so segments are independent
        marks = set(string.punctuation)
        joined = {c for p in self.score for pair in zip(p, p[1:]) if pair[1] in marks for c in pair}
        letters = "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c not in joined)
        self.segments = re.compile(f"{SPACE}*[{letters}]++(?=[{re.escape(string.punctuation)}])"
                                   f"|\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+").findall

    def halves_of(self, piece: str) -> tuple[str, str] | None:
        if piece not in self.halves:
            parts = list(piece)
            while len(parts) > 2:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = self.score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    break
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self.halves[piece] = tuple(parts) if len(parts) == 2 and piece in self.score else None
        return self.halves[piece]

    def follows(self, left: str, right: str) -> bool:
        """Whether ``[left, right]`` is the encoding of its text; both encode to themselves.

        The merges next to the border are undone, latest first. A merge across the
        border that would have come earlier than the one just undone rules the pair out.
        """
        score = self.score
        limit, ties = float("-inf"), True
        while True:
            across = score.get(left + right)
            if across is not None and (across > limit or (ties and across == limit)):
                return False
            if len(right) > 1 and (len(left) == 1 or score[right] <= score[left]):
                limit, ties, right = score[right], True, self.halves_of(right)[0]
            elif len(left) > 1:
                limit, ties, left = score[left], False, self.halves_of(left)[1]
            else:
                return True

    def learn(self, segments: list[str]) -> None:
        """Count the prefixes of new segments, in order, each from what it shares with the last."""
        fits, known = self.fits, self.known
        if len(fits) > 4 * REMEMBERED:
            fits.clear()
        last, counts, before = [""], [0], ""
        for segment in segments:
            done = 0
            for x, y in zip(before, segment):
                if x != y:
                    break
                done += 1
            del last[done + 1:], counts[done + 1:]
            for end, (token, size) in self.ends.iter(segment):      # longest token first
                if end < done:
                    continue
                while done < end:            # characters without a piece become their bytes
                    last.append(segment[done])
                    counts.append(counts[done] + len(segment[done].encode()))
                    done += 1
                j = end + 1 - size
                if j:
                    pair = last[j] + "\n" + token
                    good = fits.get(pair)
                    if good is None:
                        good = fits[pair] = self.follows(last[j], token)
                    if not good:
                        continue
                done = end + 1
                last.append(token)
                counts.append(counts[j] + 1)
            for k in range(done, len(segment)):
                last.append(segment[k])
                counts.append(counts[k] + len(segment[k].encode()))
            before = segment
            known[segment] = bytes(counts[1:]) if counts[-1] < 256 else counts[1:]

    def cut(self, text: str) -> list[str]:
        return self.segments(SPACE + text.replace(" ", SPACE)) if text else []

    def tokens(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts: the last prefix of every segment, added up."""
        split = [None if "" in w or SPACE in t else w for t, w in ((t, t.split(" ")) for t in texts)]
        words, known = self.words, self.known
        if len(words) > REMEMBERED:
            words.clear()
        if len(known) > REMEMBERED:
            known.clear()
        fresh = {w for each in split if each for w in each if w not in words}
        pieces = {w: self.cut(w) for w in fresh}
        odd = {i: self.cut(t) for i, (t, each) in enumerate(zip(texts, split)) if each is None}
        missing = {p for cut in pieces.values() for p in cut if p not in known}
        missing.update(p for cut in odd.values() for p in cut if p not in known)
        self.learn(sorted(missing))
        for w, cut in pieces.items():
            words[w] = sum([known[p][-1] for p in cut])
        out = [sum([known[p][-1] for p in odd[i]]) if each is None else sum([words[w] for w in each])
               for i, each in enumerate(split)]
        for p in missing:                    # long runs are rare; remembering them costs too much
            if len(p) > LONGEST:
                del known[p]
        for w in fresh:
            if len(w) > LONGEST:
                del words[w]
        return out

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for i from 1 to its length."""
        if not text:
            return np.zeros(0, np.int64)
        pieces = self.cut(text)
        self.learn(sorted({p for p in pieces if p not in self.known}))
        rows = [self.known[p] for p in pieces]
        ends = np.cumsum([r[-1] for r in rows])
        flat = np.array([n for r in rows for n in r], dtype=np.int64)
        before = np.repeat(np.concatenate([[0], ends[:-1]]), [len(r) for r in rows])
        return (flat + before)[1:]           # the first mark is the added space


def fitting(prefixes: np.ndarray, budget: int) -> int:
    """Length of the longest prefix such that it and all before it have at most ``budget`` tokens."""
    over = np.flatnonzero(prefixes > budget)
    return int(over[0]) if len(over) else len(prefixes)


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    """One counter per worker and model."""
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096,
                 prefixes: bool = False) -> DataFrame:
    """Token counts of whole texts of ``docs(doc_id, text)``.

    Returns ``doc_id, n_bytes, n_tokens, over_limit, fit_chars`` (characters of the
    text that fit into ``limit`` tokens) and, with ``prefixes``, ``prefix_tokens``:
    the count after each character. A null text is empty and has no tokens; ids are
    carried along as they are, null and repeated ones too; no rows give no rows.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_bytes", pa.int64()),
              pa.field("n_tokens", pa.int64()), pa.field("over_limit", pa.bool_()),
              pa.field("fit_chars", pa.int64())]
    names = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    if prefixes:
        fields.append(pa.field("prefix_tokens", pa.list_(pa.int32())))
        names += ", prefix_tokens array<int>"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(model_file)
        for batch in batches:
            rows = []
            gc.disable()                     # nothing here makes cycles, and the tables are large
            for texts in groups(batch.column("text"), GROUP):
                for text, total in zip(texts, model.tokens(texts)):
                    table = model.prefixes(text) if prefixes or total > limit else None
                    rows.append([len(text.encode()), total, total > limit,
                                 fitting(table, limit) if total > limit else len(text),
                                 *([table.astype(np.int32)] if prefixes else [])])
            gc.enable()
            made = [pa.array([r[i] for r in rows], schema.field(i + 1).type)
                    for i in range(len(fields) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], schema=schema)

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, names)
