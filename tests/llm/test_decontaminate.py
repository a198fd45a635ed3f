import random
import re

import numpy as np
import pytest

from caseweave.llm import decontaminate as d
from caseweave.llm import tokens


def test_sql(same_as_sql):
    same_as_sql(d.op7_decontamination, d.SQL)


def slow(doc, items, span=13):
    ws = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, which = ws(doc), set(), set()
    for i, t in items:
        x = ws(t)
        m = min(span, len(x))
        windows = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if x else set()
        for k in range(len(w) - m + 1):
            if tuple(w[k : k + m]) in windows:
                hit |= set(range(k, k + m))
                if i is not None:
                    which.add(str(i))
    return len(w), len(hit), sorted(which)


def test_winnowing_keeps_a_hash_in_every_window():
    rng = np.random.default_rng(0)
    for _ in range(30):
        h = rng.integers(0, 4, 80).astype(np.uint64)  # many ties
        row = np.sort(rng.integers(0, 3, 80))
        kept = set(d.winnow(tokens.grams(h, 5), row, 13, 5).tolist())
        for i in range(68):
            if row[i] == row[i + 12]:
                assert kept & set(range(i, i + 9))


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "é1", "d-d", "x", "yy", "Zß", "漢"]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, words(rng.choice([0, 1, 3, 7, 12, 13, 14, 30]))) for i in range(12)] + [(None, words(20)), (3, words(15))]
    docs = []
    for i in range(40):
        part = rng.choice(items)[1].split()
        a = rng.randrange(len(part) + 1)
        docs.append((i, f"{words(rng.randrange(30))}, {' '.join(part[a : a + rng.randrange(25)])}! {words(rng.randrange(9))}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.id: (r.n_words, r.n_hit, r["items"]) for r in d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {i: slow(t, items) for i, t in docs}


def test_very_common_passage_and_long_text(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"{passage} tail {i}") for i in range(50)] + [(99, "the " * 100_000 + passage)], "doc_id long, text string")
    rows = d.contamination(docs, spark.createDataFrame([(1, passage), (2, passage)], "item_id long, text string")).collect()
    assert {(r.n_hit, tuple(r["items"])) for r in rows} == {(20, ("1", "2"))}


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu", "c"), (2, None, "c"), (3, "", "c")], "item_id long, text string, cands string")
    rows = d.contamination(odd_docs, bench).collect()
    assert len(rows) == odd_docs.count()
    assert {r.n_hit > 0 for r in rows if r.id in (1, 2)} == {True} and {r.n_hit for r in rows if r.id in (3, 4, 5, 7)} == {0}
    assert {r.n_words for r in rows if r.id == 6} == {60_000}
    left = d.clean_of(odd_docs, bench)
    assert left.columns == odd_docs.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6, 7, 8, 9, None}
    assert d.contamination(no_docs, bench).count() == 0
    assert {r.n_hit for r in d.contamination(odd_docs, bench.limit(0)).collect()} == {0}
