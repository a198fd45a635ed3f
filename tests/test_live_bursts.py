import datetime as dt

import pytest

from caseweave.streaming import bursts

SCHEMA = "key string, id long, at timestamp"
T = dt.datetime(2024, 1, 1)


def at(minutes):
    return T + dt.timedelta(minutes=minutes)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", bursts.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path, rows, state=None, name="q", **options):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = bursts.live_bursts(stream, state, **options).writeStream.format("parquet").option("path", str(tmp_path / "out"))
    q = q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(bursts.OUT).parquet(str(tmp_path / "out")).collect()
    return sorted((r.key, r.first_id, r.third_id) for r in got), q


def test_goes_on_from_a_batch_and_fires_nothing_twice(rocks, tmp_path):
    batch = rocks.createDataFrame([("a", 1, at(0)), ("a", 2, at(10)), ("a", 3, at(20)), ("b", 4, at(0)), ("b", 5, at(30)), ("c", 6, at(0))], SCHEMA)
    state = bursts.batch_state(batch)
    assert sorted(map(tuple, state.select("key", "id", "fired").collect())) == [("a", 2, True), ("a", 3, True), ("b", 4, False), ("b", 5, False), ("c", 6, False)]
    got, _ = run(rocks, tmp_path, [("a", 7, at(25)), ("b", 8, at(40)), ("c", 9, at(600)), ("d", 10, at(30))], state)
    assert got == [("b", 4, 8)]  # a has fired in the batch, b's burst began in it
    got, _ = run(rocks, tmp_path, [("b", 11, at(45)), ("d", 12, at(600)), ("d", 13, at(601)), ("d", 14, at(602))], state)
    assert got == [("b", 4, 8), ("d", 12, 14)]  # a restart loads no state again


def test_late_rows_are_counted_and_old_state_goes(rocks, tmp_path):
    run(rocks, tmp_path, [("a", 1, at(0)), ("a", 2, at(1)), ("x", 3, at(5_000))], forget_s=7_200)
    _, q = run(rocks, tmp_path, [("a", 4, at(2)), ("x", 5, at(5_001))], forget_s=7_200)
    got, late = rocks.read.schema(bursts.OUT).parquet(str(tmp_path / "out")).count(), bursts.late_rows(q)
    assert got == 0 and late == 1
