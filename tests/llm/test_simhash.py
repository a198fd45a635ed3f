import random
import re

import numpy as np
import pytest
import xxhash

from caseweave.llm import components, simhash


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(fps, limit=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_and_blocks(monkeypatch):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = "".join(rng.choice(["Ab ", "c\t", "dé\n", "X\x0b", "yz  "]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)
        whole = simhash.fingerprint(text.encode())
        blocks = simhash.word_blocks
        monkeypatch.setattr(simhash, "word_blocks", lambda d: blocks(d, 7))
        assert simhash.fingerprint(text.encode()) == whole
        monkeypatch.setattr(simhash, "word_blocks", blocks)
    assert simhash.fingerprint(None) == 0


def clustered(rng, n):
    """Random fingerprints, and tight and loose groups."""
    out = [rng.getrandbits(64) for _ in range(n // 3)]
    for _ in range(4):
        c = rng.getrandbits(64)
        for _ in range(n // 6):
            x = c
            for _ in range(rng.randrange(8)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("seed,n", [(1, 3), (2, 60), (3, 400), (4, 1200)])
def test_index_finds_every_class(seed, n):
    fps = clustered(random.Random(seed), n)

    def rank(x):
        for s in (1, 2, 4, 8, 16, 32):
            x ^= x >> s
        return x

    fps.sort(key=rank)
    assert simhash.gray_classes(np.array(fps, np.uint64)).tolist() == slow_classes(fps)


@pytest.mark.parametrize("hot", [16_384, 20])
def test_links_like_brute_force(spark, hot):
    """Also where buckets are dealt again."""
    fps = clustered(random.Random(5), 500)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.node: r.root for r in components.connected_components(simhash.links(df, hot_rows=hot)).collect()}
    want = slow_classes(fps)
    groups = {}
    for x, c in zip(signed, want):
        groups.setdefault(c, set()).add(x)
    mine = {}
    for x in signed:
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_path(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (None, 3), (900, 901)], "u long, v long")
    got = {r.node: r.root for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 900: 900, 901: 900}
    assert components.connected_components(df.limit(0)).count() == 0


def test_query_like_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [slow_fingerprint(r.text) for r in docs]
    want = {r.doc_id: (f"{f:016x}", docs[c].doc_id) for r, f, c in zip(docs, fps, slow_classes(fps))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op1_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.simhash_components(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    zero = {r.component_id for r in rows if r.fp == 0}
    assert zero == {3}  # null and blank texts link like any other
    kept = simhash.simhash_dedup(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 2 not in ids and 4 not in ids
    assert simhash.simhash_components(no_docs).count() == 0 and simhash.simhash_dedup(no_docs).count() == 0


def test_class_without_ids_keeps_one(spark):
    df = spark.createDataFrame([(None, "same words here", 1), (None, "same words here", 2), (5, "other text altogether", 3)], "doc_id long, text string, n int")
    kept = simhash.simhash_dedup(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "same words here"), (5, "other text altogether")]


def test_an_id_with_two_texts_loses_neither(spark):
    """Id 1 names two unrelated texts, one of which id 0 copies; equal rows leave one."""
    a, b = "the quick brown fox jumps over the lazy dog", "colourless green ideas sleep furiously at night"
    df = spark.createDataFrame([(1, a), (1, b), (0, a), (2, b), (2, "quite another text of its own"), (2, "quite another text of its own")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.simhash_dedup(df).collect()) == [(0, a), (1, b), (2, "quite another text of its own")]
