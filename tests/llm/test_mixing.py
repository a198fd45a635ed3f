import json

import pytest
from pyspark.sql import functions as F

from caseweave.llm import mixing


def test_sql(same_as_sql):
    same_as_sql(mixing.op2_mixing, mixing.SQL)


def test_targets_are_capped_and_shared():
    t = mixing.targets({"a": 1, "b": 50, "c": 50, None: 0})
    assert t["a"] == 3 and float(sum(t.values())) == 101 and t[None] == 0
    assert t["c"] / t["b"] == 3 / 2
    assert mixing.targets({}) == {}


def slow_cost(patterns, quotas, passes=3):
    """Least cost by brute force over integer shares of two patterns."""
    names = list(patterns)
    best = None
    total = sum(quotas.values())

    def cost(p, n):
        size = patterns[p]
        return sum((r + 1) * max(0, min(size, n - r * size)) for r in range(passes))

    def feasible(give):
        # every source must get its quota from the patterns that hold it
        need = dict(quotas)
        for order in (names, names[::-1]):
            left, want = dict(give), dict(need)
            for p in sorted(order, key=lambda p: len(json.loads(p))):
                for s in json.loads(p):
                    x = min(left[p], want[s])
                    left[p] -= x
                    want[s] -= x
            if not any(want.values()):
                return True
        return False

    for a in range(total + 1):
        give = {names[0]: a, names[1]: total - a}
        if all(v <= passes * patterns[p] for p, v in give.items()) and feasible(give):
            c = sum(cost(p, n) for p, n in give.items())
            best = c if best is None else min(best, c)
    return best


@pytest.mark.parametrize("sizes,quotas", [((10, 10), {"a": 12, "b": 8}), ((5, 20), {"a": 3, "b": 20}), ((4, 4), {"a": 10, "b": 5}), ((30, 2), {"a": 1, "b": 6})])
def test_flow_is_least_cost(sizes, quotas):
    patterns = {'["a","b"]': sizes[0], '["b"]': sizes[1]}
    flow = mixing.route(patterns, quotas)
    for s, q in quotas.items():
        assert sum(n for (p, x), n in flow.items() if x == s) == q
    got = 0
    for p, size in patterns.items():
        n = sum(v for (x, _), v in flow.items() if x == p)
        assert n <= 3 * size
        got += sum((r + 1) * max(0, min(size, n - r * size)) for r in range(3))
    assert got == slow_cost(patterns, quotas)


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["c"]) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    out, flow = mixing.mix(df)
    got = {r.source: r.n for r in flow.groupBy("source").agg(F.sum("words").alias("n")).collect()}
    assert abs(sum(got.values()) - 900) <= 1 and set(got) == {"a", "b", "c"}
    taken = {r.pattern: r.n for r in out.groupBy("pattern").agg(F.sum("taken").alias("n")).collect()}
    for p, n in taken.items():
        assert abs(n - sum(v.words for v in flow.where(F.col("pattern") == p).collect())) <= 5


def test_odd_rows(spark, odd_docs, no_docs):
    out, _ = mixing.mix(odd_docs)
    rows = out.collect()
    assert len(rows) == odd_docs.count()
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd_docs.repartition(3))[0].collect()))
    assert mixing.mix(no_docs)[0].count() == 0
    assert mixing.mixed_documents(odd_docs).columns == odd_docs.columns


def test_rows_that_repeat_an_id_deliver_the_plan(spark):
    """One id, other sizes and sources: each row is taken as often as the plan says, and the words add up."""
    rows = [(i % 7, " ".join(["w"] * (1 + i % 23)), f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, _ = mixing.mix(df)
    want = sorted((r.id, r.size) for r in plan.collect() for _ in range(r.copies))
    got = mixing.mixed_documents(df).collect()
    assert sorted((r.doc_id, len(r.text.split())) for r in got) == want
    by = {}
    for r in got:
        by[r.source] = by.get(r.source, 0) + len(r.text.split())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    for s, t in mixing.targets(sizes).items():
        assert abs(by[s] - t) <= 23
