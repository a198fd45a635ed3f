import pytest

from caseweave.llm import quality


def test_sql(same_as_sql):
    same_as_sql(quality.op10_quality_rules, quality.SQL)


def slow_repeats(words):
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(3)})


def test_counts_like_loops(spark):
    import random

    rng = random.Random(3)
    texts = [" ".join(rng.choices("abc", k=n)) for n in (0, 1, 2, 3, 4, 5, 30, 200)] + ["a b c a b c", "a a a a", "a\n\nb\na\n a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.measure(df).collect():
        assert r._cw_n_repeat_words == slow_repeats(texts[r.doc_id].split())
        lines = [x for x in texts[r.doc_id].split("\n") if x.split()]
        assert r._cw_n_dup_lines == len(lines) - len(set(lines))


def test_lines_go_first(spark):
    prose = "\n".join(" ".join(f"w{i * 17 % 101}x{j}" for j in range(i, i + 12)) + ", as it should." for i in range(10))
    junk = "\n".join(["Home | About | Contact | Login", "All rights reserved.", "BUY!! NOW!! BUY!! NOW!!", "a# b$ c% d& e*"])
    df = spark.createDataFrame([(1, prose), (2, prose + "\n" + junk), (3, prose[:300] + "\n" + "\n".join(f"X{i} | Y{i} | Z{i} |" for i in range(40)))], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.measure(df).collect()}
    assert got[1]._cw_kept and got[1]._cw_clean == prose
    assert got[2]._cw_kept and got[2]._cw_clean == prose
    assert not got[3]._cw_kept
    assert sorted(r.doc_id for r in quality.clean_documents(df).collect()) == [1, 2]


def test_labels_agree(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.op10_quality_rules(spark, sf_dir).join(labels, "doc_id").collect()
    assert all(r.kept for r in got if r.quality == 1 and not r.base_failed)
    assert not any(r.kept for r in got if r.quality == 0)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = {(r.doc_id, r.size): r for r in quality.measure(odd_docs, prefix="_q_").collect()}
    assert len(rows) == odd_docs.count()
    assert rows[3, 3]._q_n_words == 0 and rows[3, 3]._q_base_failed and rows[3, 3]._q_clean is None
    assert rows[6, 8]._q_n_words == 60_000 == rows[6, 8]._q_n_repeat_words and rows[7, 9]._q_word_chars == 200_000
    with pytest.raises(ValueError):
        quality.measure(odd_docs)  # it has a column _cw_kept
    kept = quality.clean_documents(odd_docs)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, None}
    assert quality.measure(no_docs, prefix="_q_").count() == 0
