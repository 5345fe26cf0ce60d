import re

import brute_pii
import corpus_pipeline
from conftest import FOLDER
from test_mixing import fill
from test_near_dups import brute
from test_quality import brute as statistics

from stylegraph.sources.staging import settle


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r for r in docs.collect()}
        docs = settle(stage(spark, docs, FOLDER), name)
        out = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "quality_rules":
            quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            assert all(rows[r.doc_id] == r and not statistics(r.text)[-1] for r in out)
            clean = {i for i in rows if quality.get(i) == 1 and not statistics(rows[i].text)[-1]}
            assert len(clean & {r.doc_id for r in out}) >= 0.98 * len(clean)
        elif name == "near_dedup":
            named = brute(sorted((i, r.text) for i, r in rows.items()), 5, 80)
            assert sorted(r.doc_id for r in out) == [i for i, _, c in named if i == c]
        elif name == "personal_data":
            for r in out:
                assert not brute_pii.base(r.text) and r.n_chars == len(r.text)
                if not brute_pii.base(rows[r.doc_id].text):
                    assert r == rows[r.doc_id]
        elif name == "mixing":
            size = {i: len(r.text.encode().split()) for i, r in rows.items()}
            sizes, taken = {}, {}
            for i, r in rows.items():
                sizes[r.source] = sizes.get(r.source, 0) + size[i]
            for r in out:
                taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
            for source, target in fill(sizes).items():
                largest = max(size[i] for i, r in rows.items() if r.source == source)
                assert abs(taken.get(source, 0) - target) <= largest
            before = {r.doc_id: sum(x.doc_id == r.doc_id for x in out) for r in out}
        else:
            assert {r.doc_id for r in out} == set(before)
            first = [r for r in out if r.piece == 0]
            assert len(first) == sum(before.values())


def test_entry_lists_everything():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert "pipeline" in names and len([n for n in names if re.match(r"op\d+_", n)]) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
