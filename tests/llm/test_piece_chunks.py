import hashlib
import random

import numpy as np
import pytest
from conftest import FOLDER, LONG, ODD

from stylegraph.llm import piece_chunks
from stylegraph.llm.piece_chunks import ChunkTable, decode_pieces, encode_pieces
from stylegraph.llm.queries import QUERIES, tokenizer

MODEL = tokenizer("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts():
    rng = random.Random(5)
    letters = list(" \n▁ab<>/s0x\tÀé中😀\x00.,'-\r　") + ["the", " of", "  ", "\n\n"]
    return ["", " ", "  ", "▁", "\n", "\n\n a", " a\n b ", "<s> </s> <unk> <0x0A>", "x" * 3000, LONG] + [
        "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(4000)]


def test_equal_to_the_library(library):
    table, texts = ChunkTable(MODEL), odd_texts()
    for text, coded in zip(texts, table.encode(texts)):
        ids = np.frombuffer(coded, "<i4")
        assert ids.tolist() == library.encode(text)
        assert table.decode(ids) == library.decode(ids.tolist())


def test_each_chunk_once():
    table = ChunkTable(MODEL)
    table.encode(["one two two", "two one\none"])
    assert table.segmented == 4                     # marked one and two, a line break, one without a mark
    table.encode(["two two one"])
    assert table.segmented == 4


def test_forgets(library, monkeypatch):
    monkeypatch.setattr(piece_chunks, "REMEMBERED", 3)
    table = ChunkTable(MODEL)
    for text in odd_texts()[10:200]:
        assert np.frombuffer(table.encode([text])[0], "<i4").tolist() == library.encode(text)


def test_any_ids_decode_as_in_the_library(library):
    rng, table = random.Random(6), ChunkTable(MODEL)
    for _ in range(4000):
        ids = [rng.randrange(32000) if rng.random() < 0.6 else rng.randrange(262) for _ in range(rng.randrange(1, 12))]
        assert table.decode(np.array(ids)) == library.decode(ids)


def test_odd_rows(spark, docs_of, library):
    rows = ODD + [(None, None, "a"), (9, "퟿ ", "q")]
    got = decode_pieces(encode_pieces(docs_of(rows), MODEL), MODEL).collect()
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert encode_pieces(docs_of([]), MODEL).count() == 0
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [(r.doc_id, r.text) for r in decode_pieces(none, MODEL).orderBy("doc_id").collect()] == [(1, ""), (2, "")]


def test_whole_table(spark, library):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(tuple(r) for r in QUERIES["op12_chunk_pieces"](spark, FOLDER).collect()) == sorted(want)
