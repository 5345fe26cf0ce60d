import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import FOLDER, LONG, ODD

from oracle import compare, connect
from stylegraph.llm.queries import QUERIES, SQL
from stylegraph.llm.spelling import build_tries, one_edit_pairs, spelling_variants

NAMES = ["word", "form", "root", "n", "n_near", "form_n"]


def counted(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def near_pairs(words):
    by_hole, near = defaultdict(list), set()
    for w in words:
        for i in range(len(w)):
            by_hole[w[:i], w[i + 1:]].append(w)
            if w[:i] + w[i + 1:] in words:
                near |= {(w, w[:i] + w[i + 1:]), (w[:i] + w[i + 1:], w)}
    return near | {(a, b) for ws in by_hole.values() for a in ws for b in ws if a != b}


def brute(n, ratio=10):
    near = defaultdict(set)
    for a, b in near_pairs(n):
        near[a].add(b)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda v: (-n[v], v))
            if n[best] >= ratio * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*NAMES).collect())


@pytest.mark.parametrize("seed,letters", [(0, "ab"), (1, "abc"), (2, "aé")])
def test_pairs_of_crowded_words(spark, seed, letters):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(7, 11))) for _ in range(250)}
    words |= {"a" * k for k in range(7, 30)}
    got = one_edit_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")).collect()
    assert len(got) == len({(r.word, r.near) for r in got})
    assert {(r.word, r.near) for r in got} == near_pairs(words)


def test_long_words_take_few_rounds(spark):
    base = "x" * 3000 + "abcdefg" * 200
    words = [base, base[:-1], base[:500] + base[501:], base[:4000] + "z" + base[4001:], "y" * 5000]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    assert {(r.word, r.near) for r in one_edit_pairs(frame).collect()} == near_pairs(set(words))
    edges, _ = build_tries(frame)
    assert edges.count() < 30


def test_forms_and_roots(spark, docs_of):
    rows = [(i, "something " * 40 + "somethinh " * 3 + "Somethinhs tie_alphaaa tie_alphaab") for i in range(40)]
    rows += [(99, "somethinhz somethinhz alphaac alphaac ÀÉÎÕÜàé ÀÉÎÕÜàé Àéîõüàé")]
    got = rows_of(spelling_variants(docs_of([(i, t, "s") for i, t in rows])))
    assert got == brute(counted(rows))
    assert any(r[1] != r[2] for r in got if r[1]) and any(r[1] for r in got)


def test_odd_rows(spark, docs_of):
    rows = ODD + [(10, LONG + " longestword " * 5000, "z"), (None, "nullwords nullwords nullwords", None)]
    got = rows_of(spelling_variants(docs_of(rows)))
    assert got == brute(counted([r[:2] for r in rows])) and got
    assert spelling_variants(docs_of([])).count() == 0
    assert spelling_variants(docs_of([(1, None, "a"), (2, "short words only here", "a")])).count() == 0


def test_whole_table(spark):
    name = "op11_trie_spelling"
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES[name](spark, FOLDER)) == brute(counted(rows))
