import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import temporal

T0 = dt.datetime(2024, 1, 1)


def test_order_statistic_is_that_of_the_sort(spark):
    rng = random.Random(3)
    rows, want, ranks = [], set(), []
    for k in range(25):
        values = [rng.choice([0, 1, 7, 8191, 8192, 1 << 39, (1 << 52) - 1, rng.randrange(1 << 52)]) for _ in range(rng.randrange(1, 60))]
        rank = rng.randrange(1, len(values) + 1)
        rows += [(k, v) for v in values]
        ranks.append((k, rank))
        want.add((k, sorted(values)[rank - 1]))
    got = temporal.order_statistic(spark.createDataFrame(rows, "k int, value long"), ["k"], spark.createDataFrame(ranks, "k int, rank long"))
    assert {tuple(r) for r in got.collect()} == want


def test_a_key_of_millions_of_gaps(spark):
    n = 2_000_000
    values = spark.range(n, numPartitions=8).select(F.lit("hot").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("value"))
    got = temporal.order_statistic(values, ["k"], spark.createDataFrame([("hot", n // 2)], "k string, rank long"))
    lesser, upto = values.select(F.count_if(F.col("value") < (v := got.first().value)), F.count_if(F.col("value") <= v)).first()
    assert lesser < n // 2 <= upto
    windows = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert windows and all("prefix" in x for x in windows)  # over the children of one digit, never over a key's values


def slow_convergences(rows, width, least):
    out = {}
    for place, i, at, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        inside = {p for q, _, t, p in rows if q == place and at <= t <= at + dt.timedelta(seconds=width) and p is not None}
        if len(inside) >= least and place not in out:
            out[place] = (at, i, len(inside))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_convergences_are_those_of_sets(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), i, T0 + dt.timedelta(minutes=rng.randrange(0, 900, 5)), rng.choice(["a", "b", "c", "d", None])) for i in range(90)]
    df = spark.createDataFrame([(0, *r) for r in rows], "case_id int, place int, id int, at timestamp_ntz, party string")
    for width, least in ((3600, 3), (1800, 2), (7200, 4)):
        got = {r.place: (r["at"], r.id, r.n_parties) for r in temporal.convergences(df, width, least).collect()}
        assert got == slow_convergences(rows, width, least)


def test_a_place_with_a_million_rows_in_a_day(spark):
    rows = spark.range(1_000_000, numPartitions=8).select(
        F.lit(0).alias("case_id"), F.lit("p").alias("place"), "id", (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id") * 0.0864)).alias("at"),
        F.when(F.col("id") < 700_000, F.col("id") % 2).otherwise(F.col("id") % 500).cast("string").alias("party"),
    )
    r = temporal.convergences(rows).first()
    first = 700_000 + 2 - 250_000  # six hours hold 250,000 rows; a third party comes at row 700,002
    assert (r.id, r.n_parties) == (first, 3)
