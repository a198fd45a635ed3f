import zlib

import corpus_pipeline as cp
from caseweave.llm import mixing, quality, simhash
from test_decontaminate import slow
from test_simhash import slow_classes, slow_fingerprint


def test_stages_like_brute_force(spark, sf_dir, duck):
    """The quality rules by their SQL, then each stage by loops over what the one before kept."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    kept = {i for (i, ok) in duck.execute(f"SELECT doc_id, kept FROM ({quality.SQL})").fetchall() if ok}
    clean = {r.doc_id: r._cw_clean for r in quality.measure(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect() if r.doc_id in kept}
    ids = sorted(kept)
    classes = slow_classes([slow_fingerprint(clean[i]) for i in ids])
    one = [i for i, c in zip(ids, classes) if ids[c] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    left = []
    for i in one:
        n, hit, _ = slow(clean[i], items)
        if not (hit > 0 and 20 * hit >= n):
            left.append(i)
    sizes, by = {i: len(clean[i].split()) for i in left}, {}
    for i in left:
        by[docs[i].source] = by.get(docs[i].source, 0) + sizes[i]
    rows = cp.run(spark, sf_dir).collect()
    taken = {}
    for r in rows:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
        assert r.size == len(clean[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(clean[r.doc_id].encode())
    assert set(taken) <= set(left) and max(taken.values()) <= 3
    for s, t in mixing.targets(by).items():
        got = sum(n * sizes[i] for i, n in taken.items() if docs[i].source == s)
        assert abs(got - t) <= 1 + max(sizes[i] for i in left if docs[i].source == s) / 2
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert cp.ORACLE_SQL is None and simhash


def test_odd_tables(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs):
        for _, stage in cp.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, sf_dir)
            if stage is not cp.STAGES[-1][1]:
                assert docs.columns == columns
        assert docs.count() >= 0
