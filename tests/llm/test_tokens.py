import random
import zlib

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
import zstandard
from conftest import FOLDER, ODD
from pyarrow import fs
from tokenizers import Tokenizer

from stylegraph.llm.packing import best_fit, pack, pack_documents, pieces, plan_packing
from stylegraph.llm.queries import QUERIES
from stylegraph.llm.token_counts import PrefixCounter, count_tokens, fitting
from stylegraph.llm.token_files import FrameReader, read_token_files, write_token_files

PIECE, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text, end):
    return np.array([*Tokenizer.from_file(BYTES).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_prefixes_match_the_library():
    model, counter = sentencepiece.SentencePieceProcessor(model_file=PIECE), PrefixCounter(PIECE)
    rng = random.Random(1)
    letters = "abcde THE the!?  \n\t é日😀123.-▁²"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [" " * n + w for n in range(40) for w in ("", "x", "Hello", "\n")]
    for text, total in zip(texts, counter.tokens(texts)):
        counts = counter.prefixes(text).tolist()
        assert counts == [len(model.encode(text[:i])) for i in range(1, len(text) + 1)]
        assert total == (counts[-1] if counts else 0)
        for budget in (0, 3):
            k = fitting(counter.prefixes(text), budget)
            assert all(c <= budget for c in counts[:k]) and (k == len(text) or counts[k] > budget)


def test_counts(spark, docs_of):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for df in (spark.read.parquet(f"{FOLDER}/documents.parquet"), docs_of(ODD)):
        texts = sorted((r.doc_id or -1, r.text or "") for r in df.collect())
        got = sorted(((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in
                      count_tokens(df, PIECE, 4096).collect()))
        want = sorted((i, len(t.encode()), n := len(model.encode(t)), n > 4096) for i, t in texts)
        assert got == want
    whole = count_tokens(docs_of(ODD), PIECE, 10, prefixes=True).collect()
    assert all((r.prefix_tokens or [0])[-1] == r.n_tokens for r in whole)
    assert count_tokens(docs_of([]), PIECE).count() == 0


def check_files(df, tmp):
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.collect()), key=lambda r: r[:2])
    manifest = write_token_files(df, BYTES, 0, folder=str(tmp), files=3)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    start = 0
    for (known, doc_id, text), r in zip(rows, got, strict=True):
        want = ids_of(text, 0)
        assert (r.doc_id if known else 0, r.start, r.n_tokens) == (doc_id, start, len(want))
        assert bytes(r.ids) == want.tobytes()
        start += len(want)
    return manifest


def test_files_round_trip(spark, docs_of, tmp_path):
    manifest = check_files(spark.read.parquet(f"{FOLDER}/documents.parquet"), tmp_path / "a")
    chosen = {r.doc_id: r for r in read_token_files(manifest, [5, 17, 99_999]).collect()}
    assert set(chosen) == {5, 17}
    path = manifest.orderBy("shard").first().path
    with fs.LocalFileSystem().open_input_file(path) as source:
        reader = FrameReader(source)
        assert [i for i, _ in reader.of([int(reader.ids[2])])] == [int(reader.ids[2])]
        whole = b"".join(reader.frame(i).tobytes() for i in range(len(reader.ids)))
    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert plain == whole
    raw = bytearray(open(path, "rb").read())
    raw[int(reader.starts[1]) + 12] ^= 1
    (tmp_path / "bad").write_bytes(bytes(raw))
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "bad")) as source, pytest.raises(Exception):
        FrameReader(source).frame(1)


def test_files_of_odd_rows(docs_of, tmp_path):
    rows = [r for r in ODD if r[0] != 6] + [(6, "twice", "x"), (6, "twice", "x")]
    check_files(docs_of(rows), tmp_path / "odd")
    assert read_token_files(write_token_files(docs_of([]), BYTES, 0, folder=str(tmp_path / "none"))).count() == 0


def lower_bound(histogram, capacity):
    return -(-sum(k * n for k, n in histogram.items()) // capacity)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    rng, capacity = np.random.default_rng(seed), 256
    lengths = np.minimum(rng.geometric(0.02 if seed % 2 else 0.01, 20_000), capacity)
    histogram = dict(zip(*map(np.ndarray.tolist, np.unique(lengths, return_counts=True))))
    used, sequences = {}, 0
    for parts, times in plan_packing(histogram, capacity):
        assert sum(parts) <= capacity and times > 0
        sequences += times
        for p in parts:
            used[p] = used.get(p, 0) + times
    assert used == histogram
    assert sequences <= 1.01 * lower_bound(histogram, capacity) + 2


def test_plan_is_the_same_at_any_scale():
    """Counts a thousand times as large need a plan of about the same length."""
    rng = np.random.default_rng(0)
    histogram = {int(k): int(n) for k, n in zip(range(1, 257), rng.integers(1, 100, 256))}
    large = {k: 1000 * n for k, n in histogram.items()}
    plan = plan_packing(large, 256)
    assert sum(t for _, t in plan) <= 1.02 * lower_bound(large, 256)
    assert len(plan) < 20_000


def test_best_fit_alone():
    left = np.zeros(11, np.int64)
    left[[3, 4, 7]] = 5, 2, 3
    groups = best_fit(left, 10)
    assert sum(t for _, t in groups) == 5


def check_packing(df, capacity):
    rows = pack_documents(df, BYTES, capacity, 2).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids, cut = ids_of(text, 2), by_doc[doc_id]
        start = 0
        for k in sorted(cut):
            r = cut[k][0]
            assert r.start == start and r.ids_crc32 == zlib.crc32(ids[start:start + r.length].tobytes())
            assert r.length == capacity or k == 0
            start += r.length
        assert start == len(ids) and (len(cut) == 1 or len(ids) > capacity)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark, docs_of):
    sequences, bound = check_packing(spark.read.parquet(f"{FOLDER}/documents.parquet"), 1024)
    assert sequences <= 1.05 * bound + 2
    check_packing(docs_of(ODD), 64)
    assert pack_documents(docs_of([]), BYTES).count() == 0
    assert pieces(docs_of([(1, None, "a")]), BYTES).first().length == 1


def test_pack_refuses_bad_lengths(spark):
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 0, 70)], "doc_id bigint, piece int, length bigint"), 64).count()


def test_queries_run(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op6_prefix_token_counts", "op7_token_files"):
        assert QUERIES[name](spark, FOLDER).count() == n


def test_workers_remember_as_few_parts_as_asked():
    # the limit was one for all queries, so the last stage of the pipeline took as much as packing alone
    from stylegraph.llm.encoding import encoder
    texts = [" ".join(f"w{k}x{i}" for i in range(50)) for k in range(40)]
    own = encoder(BYTES)
    want = [own.raw([t])[0] for t in texts]
    own.known.clear()
    got = []
    for text in texts:
        got += own([text], remembered=100)
        assert len(own.known) <= 100 + 160
    assert got == want
