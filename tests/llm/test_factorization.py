import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseweave.llm import factorization as fm


def test_linear_time_form_equals_all_pairs():
    rng = np.random.default_rng(0)
    k = 1 << fm.BITS
    m = fm.Machine(0.3, rng.normal(size=k + fm.STATS), rng.normal(size=(k + fm.STATS, fm.RANK)), np.zeros(fm.STATS), np.ones(fm.STATS))
    texts = pa.array(["a b c a", "", None, "x " * 40 + "Y!"])
    _, _, of, bucket, x, stats = next(fm.features(texts, np.array([7.0, 0, 0, 82])))
    z = fm._scaled(m, stats)
    raw, _ = fm._raw(m, 4, of, bucket, x, z)
    for row in range(4):
        idx = [*bucket[of == row], *range(k, k + fm.STATS)]
        val = [*x[of == row], *z[row]]
        want = m.bias + sum(m.linear[i] * v for i, v in zip(idx, val))
        want += sum(m.factors[a] @ m.factors[b] * va * vb for p, (a, va) in enumerate(zip(idx, val)) for b, vb in list(zip(idx, val))[p + 1 :])
        assert raw[row] == pytest.approx(want, rel=1e-5)


def test_held_out_accuracy(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = fm.op8_quality_classifier(spark, sf_dir).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.predicted == r.quality for r in held) / len(held) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark, sf_dir):
    """Scores stay as they are when all held-out labels are flipped."""
    import zlib

    rows = fm.op8_quality_classifier(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(fm.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert flipped.exceptAll(labels).count() > 0
    m = fm.train(docs, flipped.where(~fm.held_out(F.col("doc_id"))))
    again = {r.id: r.score for r in fm.score(docs, m).collect()}
    assert again == pytest.approx({r.doc_id: r.score for r in rows})


def test_query_like_brute_force(spark, sf_dir):
    """Every score by a loop over words and all pairs' sums, from the text alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~fm.held_out(F.col("doc_id")))
    m = fm.train(docs, labels)
    got = {r.doc_id: r.score for r in fm.op8_quality_classifier(spark, sf_dir).collect()}
    k = 1 << fm.BITS
    for r in docs.collect():
        one = pa.array([r.text])
        words = re.findall(rb"[^\x20\x09-\x0d]+", (r.text or "").lower().encode() if (r.text or "").isascii() else bytes(fm.tokens.LOWER[np.frombuffer(r.text.encode(), np.uint8)]))
        buckets = [int(fm.tokens.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]), fm.tokens.PLAIN)[0][0] >> np.uint64(64 - fm.BITS)) for w in words]
        tf = {}
        for b in buckets:
            tf[b] = tf.get(b, 0) + 1
        norm = math.sqrt(sum(v * v for v in tf.values())) or 1
        *_, stats = next(fm.features(one, np.array([float(r.n_chars or 0)])), (None, np.zeros((1, fm.STATS))))
        x = {**{b: v / norm for b, v in tf.items()}, **{k + i: v for i, v in enumerate(fm._scaled(m, stats)[0])}}
        idx, val = np.array([*x]), np.array([*x.values()])
        v = m.factors[idx] * val[:, None]
        pairs = ((v.sum(0) ** 2).sum() - (v**2).sum()) / 2
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-(m.bias + m.linear[idx] @ val + pairs))), abs=1e-4)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (6, 0), (7, 0), (None, 1), (2, None), (9, 1)], "doc_id long, quality int")
    m = fm.train(odd_docs, labels)
    rows = fm.score(odd_docs, m).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.id == 1}) == 1
    assert fm.score(no_docs, m).count() == 0
    nothing = fm.train(odd_docs, labels.limit(0))
    assert {r.score for r in fm.score(odd_docs, nothing).collect()} == {0.5}
    plain = fm.score(odd_docs.drop("n_chars"), m)
    assert plain.where(F.col("score").isNull()).count() == 0


def test_registered_sql_is_text():
    from caseweave.llm import queries

    assert all(isinstance(sql, str) for sql in queries.oracle_sql().values())


def test_a_hot_id_brings_no_more_rows_than_the_bound(spark, monkeypatch):
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit(9).cast("long").alias("n_chars"))
    docs = docs.unionByName(docs.limit(500))  # and rows that repeat
    labels = spark.createDataFrame([(7, 1), (7, 0)], "doc_id long, quality int")
    seen, fit = [], fm.fit
    monkeypatch.setattr(fm, "fit", lambda labels, *a: seen.append(len(labels)) or fit(labels, *a))
    a = fm.train(docs, labels, most_rows=100)
    b = fm.train(docs.repartition(5), labels, most_rows=100)
    assert seen == [100, 100] and np.array_equal(a.linear, b.linear)
