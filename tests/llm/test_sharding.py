import zlib

import pytest
from pyspark.sql import functions as F

from caseweave.llm import sharding


def test_sql(same_as_sql):
    same_as_sql(sharding.op6_sharding, sharding.SQL)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard(df, sharding.tree_of(8), sharding.tree_of(9)).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(sizes) < 1.15 * min(sizes) and 1_900 < sum(r.grown_shard == 8 for r in rows) < 2_550


def test_movement_stays_in_changed_subtrees(spark):
    tree = {"a": {"a1": {0: 1.0, 1: 1.0}, "a2": {2: 2.0}}, "b": {"b1": {3: 1.0}}}
    other = {"a": {"a1": {0: 1.0, 1: 0.5}, "a2": {2: 2.5}}, "b": {"b1": {3: 1.0}}}  # a keeps its weight
    df = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.shard(df, tree, other).collect()
    assert all((r.shard == 3) == (r.grown_shard == 3) for r in rows)
    assert {(r.shard, r.grown_shard) for r in rows if r.shard != r.grown_shard} <= {(1, 2), (1, 0), (0, 2)}
    share = sum(r.shard == 2 for r in rows) / len(rows)
    assert abs(share - 0.4) < 0.03


def test_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.shard(odd_docs, sharding.tree_of(3)).collect()
    assert len(rows) == odd_docs.count()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert len({r.shard for r in rows if r.id == 1}) == 1
    by_id = {r.id: r for r in rows}
    assert by_id[3].size == 1 and by_id[3].text_crc32 == 0 and by_id[7].text_crc32 == zlib.crc32(b"x" * 200_000)
    assert sharding.shard(no_docs, sharding.tree_of(3)).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(odd_docs, {"a": {"b": {0: 0.0}}})
