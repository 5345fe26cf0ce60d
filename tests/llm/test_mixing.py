import duckdb
import pytest
from conftest import FOLDER, ODD
from oracle import compare, connect

from stylegraph.llm import mixing
from stylegraph.llm.mixing import emit, mix, source_targets
from stylegraph.llm.queries import QUERIES, SQL


def fill(sizes, weights=(1, 2, 3), repeat=3):
    """Targets by plain rounds of resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        if not rest:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in rest)
        above = [s for s in rest if weight[s] * level > repeat * sizes[s]]
        if not above:
            return fixed | {s: weight[s] * level for s in rest}
        fixed |= {s: repeat * sizes[s] for s in above}


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1, "c": 100, None: 7}, {"é": 0, "z": 5, "\U0001F600": 9}, {"a": 4}, {"a": 1, "b": 1, "c": 1000, "d": 2, "e": 3}])
def test_targets(spark, sizes):
    got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint"))
    want = fill(sizes)
    for row in got.collect():
        assert row.target == pytest.approx(want[row.source])


def test_query(spark):
    assert compare(QUERIES["op1_mix_sources"](spark, FOLDER), connect(FOLDER), SQL["op1_mix_sources"]) is None


def test_taken_near_target_and_rerun(spark):
    df = spark.read.parquet(f"{FOLDER}/documents.parquet")
    first, again = (sorted(map(tuple, mix(df).select("doc_id", "source", "size", "target", "taken").collect())) for _ in range(2))
    assert first == again
    for source in {r[1] for r in first}:
        rows = [r for r in first if r[1] == source]
        assert abs(sum(r[4] for r in rows) - rows[0][3]) <= max(r[2] for r in rows)
        assert all(r[4] <= 3 * r[2] for r in rows)


def test_odd_rows(docs_of):
    got = {(r.doc_id, r.size): r for r in mix(docs_of(ODD)).collect()}
    assert len(mix(docs_of(ODD)).collect()) == len(ODD)
    assert got[1, 0].taken == got[2, 0].taken == 0 and got[7, 30_001].size == 30_001
    assert mix(docs_of([])).count() == 0


def test_emit(docs_of):
    rows = [(i, f"text {i} " * (i % 7 + 1), f"s{i % 3}") for i in range(60)] + [(5, "text 5 " * 6, "s2")]
    df = docs_of(rows)
    mixed = mix(df, weights=(1, 5, 9))
    out = emit(df, mixed)
    assert out.columns == df.columns
    assert out.count() == mixed.agg({"copies": "sum"}).first()[0]


def test_emit_repeated_ids(docs_of):
    """Every source and size gets its own copies, also under one id, and rows that look alike share theirs."""
    rows = [(None if i % 2 else 5, f"{i} " + "w " * (i % 5 * 30), f"s{i % 3}") for i in range(300)]
    rows += [(7, f"{i} like all others", "s0") for i in range(50)]
    df = docs_of(rows)
    mixed = mix(df, weights=(1, 5, 9))
    want, got = {}, {}
    for r in mixed.collect():
        key = r.doc_id, r.source, r.size
        want[key] = want.get(key, 0) + r.copies
    out = emit(df, mixed).collect()
    for r in out:
        key = r.doc_id, r.source, len(r.text.split())
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    alike = [sum(r.text == t for r in out) for i, t, _ in rows if i == 7]
    assert max(alike) - min(alike) == 1


def test_texts_stay_where_they_are(spark, docs_of, monkeypatch):
    """The mix travels to the texts while it fits; beyond, the same rows come by a shuffle."""
    rows = [(i, f"text {i} " * (i % 7 + 1), f"s{i % 3}" if i % 5 else None) for i in range(60)]
    df = docs_of(rows, extra=False)
    mixed = mix(df, weights=(1, 5, 9))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans, found = [], []
        for most in (64 << 20, 0):
            monkeypatch.setattr(mixing, "MAX_HOT_BYTES", most, raising=False)
            out = emit(df, mixed)
            plans.append(out._jdf.queryExecution().executedPlan().toString())
            found.append(sorted(map(str, out.collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1] and found[0] == found[1]
