"""Operators against plain loops on small random inputs, and their edge cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caseweave.operators import graph, integrity, joins, resolve, rollups, rules, temporal

T0 = dt.datetime(2024, 1, 1)


def contacts(spark, rows):
    return spark.createDataFrame(rows, "case_id int, id int, subject int, object int, at timestamp_ntz")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bursts_and_relays_like_loops(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), i, *rng.sample(range(6), 2), T0 + dt.timedelta(minutes=rng.choice([0, 30, 60, 119, 120, 121, 500]) + 120 * rng.randrange(30))) for i in range(200)]
    df = contacts(spark, rows).withColumns({"left": F.least("subject", "object"), "right": F.greatest("subject", "object")})
    by = {}
    for c, i, a, b, t in sorted(rows, key=lambda r: (r[4], r[1])):
        by.setdefault((c, min(a, b), max(a, b)), []).append((t, i))
    want = {}
    for k, xs in by.items():
        for (t1, i1), (_, i2), (t3, i3) in zip(xs, xs[1:], xs[2:]):
            if (t3 - t1).total_seconds() <= 7200:
                want[k] = (i1, i2, i3)
                break
    got = {(r.case_id, r.left, r.right): (r.first_id, r.second_id, r.third_id) for r in temporal.bursts(df, ["case_id", "left", "right"]).collect()}
    assert got == want
    paths = {}
    ordered = sorted(rows, key=lambda r: (r[4], r[1]))
    for x, (c, i, a, b, t) in enumerate(ordered):
        for c2, j, p, q, u in ordered[x + 1 :]:
            if c2 == c and (u - t).total_seconds() <= 7200:
                for mid, other in ((a, b), (b, a)):
                    for mid2, other2 in ((p, q), (q, p)):
                        if mid == mid2 and other != other2:
                            paths.setdefault((c, other, mid, other2), (i, j))
    assert {(r.case_id, r.a, r.middle, r.b): (r.first_id, r.second_id) for r in temporal.relays(df).collect()} == paths


def test_rapid_bounds(spark):
    rows = [(0, 1, T0), (0, 2, T0 + dt.timedelta(minutes=90)), (1, 3, T0), (1, 4, T0 + dt.timedelta(minutes=90, seconds=1)), (2, 5, None), (2, 6, T0)]
    df = spark.createDataFrame(rows, "case_id int, id int, at timestamp_ntz")
    assert [(r.case_id, r.first_id, r.second_id) for r in temporal.rapid_sequence(df, ["case_id"]).collect()] == [(0, 1, 2)]


def test_silence(spark):
    at = [0, 10, 20, 200]
    rows = [(0, i, 1, 2, T0 + dt.timedelta(hours=h)) for i, h in enumerate(at[:3])] + [(0, 9, 3, 4, T0 + dt.timedelta(hours=200))]
    got = temporal.silences(contacts(spark, rows), ["case_id", "subject", "object"]).collect()
    assert [(r.subject, r.contacts, r.usual_s, r.silent_s) for r in got] == [(1, 3, 36000.0, 648000.0)]


def edges(spark, pairs):
    rows = [(0, min(u, v), max(u, v), w, 1 / max(w, 0.01), 1, 1) for u, v, w in pairs]
    return spark.createDataFrame(rows, "case_id int, u int, v int, weight double, distance double, observations long, n_evidence long")


def test_graph_kernels(spark):
    e = edges(spark, [(1, 2, 0.9), (2, 3, 0.8), (1, 3, 0.9), (3, 4, 0.9), (4, 5, 0.5), (5, 6, 0.9), (4, 6, 0.9)])
    m = {r.node: r for r in graph.node_measures(e).collect()}
    assert {x for x, r in m.items() if r.is_cut} == {3, 4}
    assert m[3].betweenness == m[4].betweenness == 0.6 and m[1].betweenness == 0
    assert [(r.u, r.v) for r in graph.bridge_edges(e).collect()] == [(3, 4)]
    assert {(r.node, r.community) for r in graph.communities(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)}
    p = graph.shortest_path(e, 1, 5).first()
    assert p.path == "1>3>4>5" and p.weakest == 0.5
    assert graph.shortest_path(e, 1, 99).first().reason
    from caseweave.operators.lineage import shared_checkpoint

    far = graph.shortest_path(e, 1, 5, shared_checkpoint(spark), most_nodes=2).first()
    assert far == p
    assert graph.shortest_path(e, 1, 99, shared_checkpoint(spark), most_nodes=2).first() == graph.shortest_path(e, 1, 99).first()
    assert {r.node: r.level for r in graph.bfs_levels(e, 1).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 3}
    assert graph.ego_subgraph(e, 1, 1).count() == 3


def test_components(spark):
    e = edges(spark, [(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 5, 1.0), (8, 9, 1.0)])
    from caseweave.operators.lineage import shared_checkpoint

    got = {r.node: r.component for r in graph.node_components(e, shared_checkpoint(spark)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


def test_rejected_and_self_edges_do_not_count(spark):
    r = spark.createDataFrame(
        [(0, "a", "b", "CALLED", 0.9, 1, None), (0, "b", "a", "CALLED", 0.5, 2, "x"), (0, "a", "c", "CALLED", 0.9, 1, "rejected"), (0, "a", "a", "CALLED", 0.9, 1, "x")],
        "case_id int, subject string, object string, relation_type string, confidence double, evidence_id int, status string",
    )
    row = graph.build_edges(r).collect()
    assert [(x.u, x.v, x.weight, x.observations, x.n_evidence) for x in row] == [("a", "b", 0.9, 2, 2)]


def entry(i, payload, prev):
    import hashlib

    return i, hashlib.sha256(f"{payload}|{prev or ''}".encode()).hexdigest()


def chain(n):
    rows, prev = [], None
    for i in range(n):
        _, h = entry(i, f"p{i}", prev)
        rows.append(["k", i, i, f"p{i}", prev, h])
        prev = h
    return rows


def verify(spark, rows, **options):
    df = spark.createDataFrame(rows, "k string, id int, at int, payload string, previous_hash string, event_hash string")
    r = integrity.verify_chain(df, ["k"], **options).first()
    return r.status, r.first_break, r.reason


def test_chain(spark):
    assert verify(spark, chain(5)) == ("intact", None, None)
    rows = chain(5)
    rows[2][3] = "other"
    assert verify(spark, rows) == ("broken", 2, "content_altered")
    assert verify(spark, chain(5)[:2] + chain(5)[3:]) == ("broken", 3, "link_broken")
    assert verify(spark, chain(5)[2:]) == ("intact", None, None)
    assert verify(spark, chain(5)[2:], strict=True) == ("broken", 2, "link_broken")
    assert verify(spark, [["k", 0, 0, "p", None, None]])[0] == "unchained"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_merkle(spark, n):
    import hashlib

    hs = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    level = hs
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    df = spark.createDataFrame([("k", i, h) for i, h in enumerate(hs)], "k string, place int, hash string")
    assert integrity.merkle_roots(df, ["k"]).first().root == level[0]
    path = integrity.merkle_proof(df, ["k"], n // 2)
    steps = [(r.hash, r.left) for r in sorted(path.collect(), key=lambda r: r.level)] if path is not None else []
    assert integrity.verify_proof(hs[n // 2], steps, level[0])


def test_hmac(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("phone:é",)], "m string").select(integrity.hmac_sha256("k" * 70, F.col("m")).alias("x")).first().x
    assert got == hmac.new(b"k" * 70, "phone:é".encode(), hashlib.sha256).hexdigest()


def test_resolution(spark):
    rows = [(0, 1, 1, 1, "Asha Rao", ["98765 43210", "+919876543210"]), (0, 2, 2, 2, "asha rao", []), (0, 3, 3, 3, None, None)]
    df = spark.createDataFrame(rows, "case_id int, evidence_id int, record_id int, created_at int, sender string, phone_numbers array<string>")
    found = resolve.identities(df)
    got = {(r.entity_type, r.key): (r.display, r.mentions) for r in resolve.entities(found).collect()}
    assert got == {("person", "asha rao"): ("Asha Rao", 2), ("phone", "9876543210"): ("+919876543210", 2)}
    assert resolve.occurrences(found).count() == 3
    assert [(r.subject, r.object) for r in resolve.co_occurrence_edges(found).collect()] == [("person:asha rao", "phone:9876543210")]


def test_upsert_keeps_reviewed(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k int, v string, seen boolean")
    new = spark.createDataFrame([(1, "x", False), (2, "y", False), (3, "z", False)], "k int, v string, seen boolean")
    assert {(r.k, r.v) for r in resolve.upsert(old, new, "k", F.col("seen")).collect()} == {(1, "a"), (2, "y"), (3, "z")}


def test_contradictions_and_shared_values(spark):
    rows = [(0, 1, 1, "R-1", 10.0, "INR", T0), (0, 2, 2, "r-1 ", 10.005, "INR", T0), (0, 3, 3, "R-1", 12.0, "USD", T0 + dt.timedelta(days=2)), (0, 4, 3, "R-1", 9.0, "INR", T0)]
    df = spark.createDataFrame(rows, "case_id int, record_id int, evidence_id int, reference string, amount double, currency string, at timestamp_ntz")
    got = {(r.left, r.right): r.fields for r in joins.contradictions(df).collect()}
    assert got == {(1, 3): "amount,currency,event_time", (2, 3): "amount,currency,event_time", (1, 4): "amount", (2, 4): "amount"}
    v = joins.shared_values(df, {"reference": "reference"})
    assert {(r.left, r.right, r.confidence) for r in joins.exact_matches(v).collect()} == {(1, 2, 0.9), (1, 3, 0.9), (1, 4, 0.9), (2, 3, 0.9), (2, 4, 0.9)}


@pytest.mark.parametrize(("most", "hits"), [(65_536, 2_000_000), (40, 2_000_000), (40, 7)])
def test_relays_of_a_busy_middle_in_blocks(spark, monkeypatch, most, hits):
    monkeypatch.setattr(temporal, "RELAY_HITS", hits)
    rng = random.Random(most + hits)
    rows = [(0, i, f"u{rng.randrange(25)}", f"k{rng.randrange(2)}", T0 + dt.timedelta(minutes=30 * rng.randrange(60))) for i in range(300)]
    rows += [(0, None, "u1", "k1", T0), (1, 900, "u2", "k1", T0), (0, 901, "u1", "u1", T0), (0, 902, "u3", "k0", None)]
    df = spark.createDataFrame(rows, "case_id int, id int, subject string, object string, at timestamp_ntz")
    paths = {}
    for c, i, a, b, t in sorted((r for r in rows if r[4]), key=lambda r: (r[4], r[1] is not None, r[1])):
        for c2, j, p, q, u in sorted((r for r in rows if r[4]), key=lambda r: (r[4], r[1] is not None, r[1])):
            later = u > t or u == t and i is not None and j is not None and j > i
            if c == c2 and later and (u - t).total_seconds() <= 7200 and a != b and p != q:
                for mid, other in ((a, b), (b, a)):
                    for mid2, other2 in ((p, q), (q, p)):
                        if mid == mid2 and other != other2:
                            paths.setdefault((c, other, mid, other2), (i, j, int((u - t).total_seconds() // 60)))
    found = temporal.relays(df, most=most)
    assert sorted((r.case_id, r.a, r.middle, r.b) for r in found.collect()) == sorted(paths)
    assert {(r.case_id, r.a, r.middle, r.b): (r.first_id, r.second_id, r.minutes) for r in found.collect()} == paths
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert "FlatMapGroupsInArrow" in plan[0]  # hits aren't shuffled


def test_unique_alerts_meet_what_is_raised_of_their_rule(spark):
    t = spark.createDataFrame([(0, 1, 60000.0), (0, 2, 70000.0)], "case_id int, id int, amount double")
    high = rules.high_value(t)
    other = rules.alert(t, "RELAY_CONTACT", "MEDIUM", F.col("id"))
    got = rules.evaluate(high, raised=high.where("key = '1'"), unique={"RELAY_CONTACT": other})
    assert sorted((r.rule, r.key) for r in got.collect()) == [("HIGH_VALUE_TRANSFER", "2"), ("RELAY_CONTACT", "1"), ("RELAY_CONTACT", "2")]
    raised = other.unionByName(high)
    assert rules.evaluate(high, raised=raised.where("key = '1'"), unique={"RELAY_CONTACT": other}).count() == 2


def test_alerts_are_idempotent(spark):
    t = spark.createDataFrame([(0, 1, 60000.0, "Bo"), (0, 2, 10.0, "bo"), (0, 3, None, None)], "case_id int, id int, amount double, receiver string")
    first = rules.evaluate(rules.high_value(t), rules.repeated_recipient(t), rules.high_value(t))
    assert {(r.rule, r.key) for r in first.collect()} == {("HIGH_VALUE_TRANSFER", "1"), ("REPEATED_RECIPIENT", "bo")}
    assert rules.evaluate(rules.high_value(t), raised=first).count() == 0


def test_traceability_of_nothing(spark):
    empty = spark.createDataFrame([], "case_id int, ok boolean")
    assert rollups.traceability(empty, F.col("ok")).count() == 0
