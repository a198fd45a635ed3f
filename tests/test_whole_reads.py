"""Reads that SQL can't restate, against loops and definitions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.operators import graph
from caseweave.operators.lineage import shared_checkpoint
from caseweave.plans import catalogue, standins


def small_graph(seed, n, m):
    rng = random.Random(seed)
    pairs = sorted(rng.sample(list(itertools.combinations(range(n), 2)), m))
    return {e: rng.randint(2, 10) / 10 for e in pairs}


def parts(nodes, edges):
    label = {x: x for x in nodes}
    for _ in nodes:
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    return len(set(label.values()))


@pytest.fixture(scope="module")
def graphs(spark):
    cases = {c: small_graph(c, n, m) for c, (n, m) in enumerate([(8, 8), (9, 12), (10, 11), (7, 20)])}
    rows = [(c, u, v, w, 1, 1, "CALLED", 1 / w) for c, es in cases.items() for (u, v), w in es.items()]
    return cases, spark.createDataFrame(rows, "case_id int, u int, v int, weight double, observations long, n_evidence long, relation_types string, distance double").cache()


def test_cut_nodes_and_bridges_by_removal(spark, graphs):
    cases, df = graphs
    got = {(r.case_id, r.node): r.is_cut for r in graph.node_measures(df).collect()}
    found = {(r.case_id, r.u, r.v) for r in graph.bridge_edges(df).collect()}
    for c, es in cases.items():
        nodes = {x for e in es for x in e}
        whole = parts(nodes, es)
        for x in nodes:
            rest = [e for e in es if x not in e]
            lone = all(x in e for e in es)
            assert got[c, x] == (not lone and parts(nodes - {x}, rest) > whole), (c, x)
        assert {e for e in es if parts(nodes, [f for f in es if f != e]) > whole} == {(u, v) for k, u, v in found if k == c}


def test_betweenness_by_all_shortest_paths(spark, graphs):
    cases, df = graphs
    got = {(r.case_id, r.node): r.betweenness for r in graph.node_measures(df).collect()}
    for c, es in cases.items():
        nodes = sorted({x for e in es for x in e})
        step = {**{(u, v): 1 / w for (u, v), w in es.items()}, **{(v, u): 1 / w for (u, v), w in es.items()}}

        def walks(path, d):
            yield path, d
            for y in nodes:
                if (path[-1], y) in step and y not in path:
                    yield from walks((*path, y), d + step[path[-1], y])

        score = dict.fromkeys(nodes, 0.0)
        for s in nodes:
            best = {}
            for path, d in walks((s,), 0.0):
                best.setdefault(path[-1], []).append((d, path))
            for t, ways in best.items():
                if t == s:
                    continue
                least = min(d for d, _ in ways)
                short = [p for d, p in ways if d <= least + 1e-9]
                for p in short:
                    for x in p[1:-1]:
                        score[x] += 1 / len(short)
        n = len(nodes)
        for x in nodes:
            assert got[c, x] == pytest.approx(score[x] / ((n - 1) * (n - 2)), abs=2e-6)


def test_eigenvector_by_linear_algebra(spark, graphs):
    cases, df = graphs
    got = {(r.case_id, r.node): r.score for r in graph.eigenvector(df, close=1e-9).collect()}
    for c, es in cases.items():
        nodes = sorted({x for e in es for x in e})
        if parts(nodes, es) > 1:
            continue
        a = np.zeros((len(nodes),) * 2)
        for (u, v), w in es.items():
            a[nodes.index(u), nodes.index(v)] = a[nodes.index(v), nodes.index(u)] = w
        want = np.abs(np.linalg.eigh(a)[1][:, -1])
        assert [got[c, x] for x in nodes] == pytest.approx(list(want), abs=1e-4)


def test_levels_of_all_nodes(spark, graphs):
    cases, df = graphs
    got = {(r.case_id, r.node): r.level for r in graph.all_levels(df, None, shared_checkpoint(spark)).collect()}
    for c, es in cases.items():
        deg = {}
        for e in es:
            for x in e:
                deg[x] = deg.get(x, 0) + 1
        root = min(deg, key=lambda x: (-deg[x], x))
        level, front = {root: 0}, [root]
        while front:
            front = sorted({y for e in es for x, y in (e, e[::-1]) if x in front and y not in level})
            level |= {y: max(level.values()) + 1 for y in front}
        deepest = max(level.values())
        assert {x: got[c, x] for x in deg} == {x: level.get(x, deepest + 1) for x in deg}


def test_important_entities_and_overview(spark, graphs):
    cases, df = graphs
    cut = shared_checkpoint(spark)
    measures = {(r.case_id, r.node): r for r in graph.node_measures(df).collect()}
    home = {(r.case_id, r.node): r.community for r in graph.communities(df).collect()}
    rows = graph.important(df, cut, "betweenness", F.col("node") > 1, 3).collect()
    for c, es in cases.items():
        nodes = [x for x in {x for e in es for x in e} if x > 1]
        want = sorted(nodes, key=lambda x: (-measures[c, x].betweenness, x))[:3]
        mine = sorted((r for r in rows if r.case_id == c), key=lambda r: r.rank)
        assert [r.node for r in mine] == want
        for r in mine:
            near = {y for e in es for x, y in (e, e[::-1]) if x == r.node}
            assert r.connections == len(near) == r.n_evidence and r.communities_linked == len({home[c, y] for y in near}) and r.is_bridge == measures[c, r.node].is_cut
    over = {r.case_id: r for r in graph.whole_overview(df, cut).collect()}
    for c, es in cases.items():
        assert over[c].relationships == len(es) and over[c].communities == len({v for (k, _), v in home.items() if k == c})


def test_whole_queries_hold_together(spark, sf_dir):
    q = catalogue.queries()
    plain = {tuple(r) for r in q["evaluate_alerts"](spark, sf_dir).collect()}
    bridges = {(int(r.case_id), r.rule, r.severity, r.key) for r in q["rule_bridge_entity"](spark, sf_dir).collect()}
    assert {tuple(r) for r in q["evaluate_alerts_whole"](spark, sf_dir).collect()} == plain | bridges
    edges = graph.build_edges(standins.relations(spark, sf_dir)).select("case_id", "u", "v", "distance").toPandas()
    fragile = {(int(c), x) for c, part in edges.groupby("case_id") for e in graph.cuts(graph._adjacency(part))[1] for x in e}
    for r in q["requisition_draft"](spark, sf_dir).collect():
        assert r.load_bearing == ((r.case_id, r.node) in fragile)
    assert q["important_entities_whole"](spark, sf_dir).count() == q["important_entities"](spark, sf_dir).count()
    assert q["network_overview_whole"](spark, sf_dir).count() == q["network_overview"](spark, sf_dir).count()
