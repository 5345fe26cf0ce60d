import random

import brute_pii as brute
import pytest
from conftest import FOLDER, ODD

from stylegraph.llm import personal_data
from stylegraph.llm.personal_data import find_personal_data, redact, summary
from stylegraph.llm.queries import QUERIES


def agrees(rows, texts):
    for r in rows:
        spans = brute.base(texts[r.doc_id])
        assert r.base_sha256 == brute.digest(texts[r.doc_id]), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in brute.KINDS]
        assert {brute.joined([s]) for s in spans} <= set(r.spans.split(","))


def test_base_spans_of_noise(docs_of):
    rng = random.Random(3)
    letters = list("ab1234567890..--  +()@@_%é😀\n") + ["1.2.3.4", "4111111111111111", "@x.com", "+1 23", "256.1.1.1"]
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60))), "s") for i in range(1500)]
    rows += [(5000, "1" * 20_000, "s"), (5001, "a@b.c " * 500, "s"), (5002, "a@b" + ".c" * 3000, "s"), (5003, "1 " * 3000, "s"),
             (5004, "a@b.c_d@e.f a.b@c.d@e.f", "s"), (5005, "4111 1111-1111 1111. 4111111111111112", "s")]
    agrees(summary(find_personal_data(docs_of(rows))).collect(), {i: t for i, t, _ in rows})


def test_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op2_contextual_pii"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    agrees(rows, texts)


def contextual():
    """Seeds behind 'reach me' teach the pattern; identifiers behind it are unseen, elsewhere common words follow."""
    rows = [(i, f"say hello and reach me user{i}@mail.example.com today of the day", "s") for i in range(8)]
    rows += [(100, "please reach me agent-77001122 (now) of the 12345 things", "s"),
             (101, "the code agent-77001122 again, and of the 54321 others", "s")]
    rows += [(200 + i, f"of the day and of the night of the u{i}@x.example.org end", "s") for i in range(4)]
    return rows


@pytest.mark.parametrize("listed", [20_000, 0])
def test_contexts_find_unseen_identifiers(docs_of, monkeypatch, listed):
    monkeypatch.setattr(personal_data, "LISTED_PATTERNS", listed)
    rows = {r.doc_id: r for r in summary(find_personal_data(docs_of(contextual()))).collect()}
    texts = {i: t for i, t, _ in contextual()}
    agrees(rows.values(), texts)
    for i in (100, 101):
        at = texts[i].index("agent")
        assert rows[i].spans == f"email:{at}:{at + 14}"      # and not the numbers behind 'of the'
        assert rows[i].n_email == 0
    assert rows[200].spans == brute.joined(brute.base(texts[200]))


def test_redaction(docs_of):
    df = docs_of(contextual() + [(300, "1234567890123456@x.com 10.0.0.1 and +1 (988) 555-2485", "s"), (301, None, "s"),
                                 (None, "mail a@b.cc", "s"), (None, "mail a@b.cc", "s")])
    out = redact(df)
    assert out.columns == df.columns
    rows = out.collect()
    texts = {r.doc_id: r.text for r in rows}
    assert len(rows) == df.count() and texts[301] is None and texts[None] == "mail [EMAIL]"
    assert texts[300] == "[EMAIL] [IP] and [PHONE]"
    assert texts[100] == "please reach me [EMAIL] (now) of the 12345 things"
    assert not any(brute.base(t) for t in texts.values())


def test_odd_rows(docs_of):
    rows = [(i, t if i != 7 else "word " * 3000 + "9" * 5000, s) for i, t, s in ODD]
    got = summary(find_personal_data(docs_of(rows))).collect()
    assert len(got) == len(rows) and {r.spans for r in got} == {""}
    assert find_personal_data(docs_of([])).count() == 0 and redact(docs_of([])).count() == 0
