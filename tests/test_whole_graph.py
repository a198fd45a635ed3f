"""Graph queries read every unrejected relation, and cases of any size."""

import random

import pytest

from caseweave.operators import graph
from caseweave.operators.lineage import shared_checkpoint
from caseweave.plans import catalogue, standins


@pytest.mark.parametrize("name", ["node_measures", "communities", "eigenvector_centrality"])
def test_node_queries_cover_the_whole_graph(name, spark, sf_dir):
    nodes = graph.ends(graph.build_edges(standins.relations(spark, sf_dir))).select("case_id", "node").distinct()
    got = catalogue.queries()[name](spark, sf_dir).select("case_id", "node")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, nodes.collect()))


def test_bridge_query_covers_the_whole_graph(spark, sf_dir):
    rows = graph.build_edges(standins.relations(spark, sf_dir)).select("case_id", "u", "v", "distance").toPandas()
    want = [(int(case), *e) for case, part in rows.groupby("case_id") for e in graph.cuts(graph._adjacency(part))[1]]
    assert sorted((r.case_id, r.u, r.v) for r in catalogue.queries()["bridge_edges"](spark, sf_dir).collect()) == sorted(want)


def test_path_query_covers_the_whole_graph(spark, sf_dir):
    cases = graph.build_edges(standins.relations(spark, sf_dir)).select("case_id").distinct().count()
    assert catalogue.queries()["shortest_path"](spark, sf_dir).count() == cases


@pytest.fixture(scope="module")
def odd_edges(spark):
    """A tree, a ring with tails, two triangles that share a node, two parts, and a random graph with and without cut nodes."""
    rng = random.Random(3)
    cases = [
        [(1, 2), (2, 3), (2, 4), (4, 5)],
        [(1, 2), (2, 3), (3, 4), (1, 4), (4, 5), (5, 6)],
        [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (3, 5)],
        [(1, 2), (3, 4), (4, 5), (3, 5), (5, 6)],
        *(sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}) for n, m in [(30, 32), (30, 45), (30, 90)]),
    ]
    rows = [(c, u, v, w, 1, 1, "X", 1 / w) for c, es in enumerate(cases) for u, v in es for w in [rng.randint(2, 10) / 10]]
    return spark.createDataFrame(rows, "case_id int, u int, v int, weight double, observations long, n_evidence long, relation_types string, distance double").cache()


def test_cuts_and_bridges_by_joins_match_the_kernel(spark, odd_edges):
    cut = shared_checkpoint(spark)
    pick = lambda df: sorted((r.case_id, r.node) for r in df.where("is_cut").collect())
    assert pick(graph.node_measures(odd_edges, cut, most_nodes=2)) == pick(graph.node_measures(odd_edges)) != []
    pairs = lambda df: sorted((r.case_id, r.u, r.v) for r in df.collect())
    assert pairs(graph.bridge_edges(odd_edges, cut, most_nodes=2)) == pairs(graph.bridge_edges(odd_edges)) != []


def test_eigenvector_by_joins_matches_the_kernel(spark, odd_edges):
    few = odd_edges.where("case_id IN (1, 3, 6)")
    got = {(r.case_id, r.node): r.score for r in graph.eigenvector(few, 40, 1e-3, shared_checkpoint(spark), 2).collect()}
    want = {(r.case_id, r.node): r.score for r in graph.eigenvector(few, 40, 1e-3).collect()}
    assert got == pytest.approx(want, abs=2e-6)


@pytest.fixture(scope="module")
def parted_edges(spark):
    """Two cases of six random parts and a chain each."""
    rng = random.Random(8)
    rows = []
    for c in (0, 1):
        for k in range(6):
            pairs = {tuple(sorted(rng.sample(range(100 * k, 100 * k + 9), 2))) for _ in range(14)}
            rows += [(c, f"n{u}", f"n{v}") for u, v in sorted(pairs)]
        rows += [(c, f"n{u}", f"n{u + 1}") for u in range(700, 708)]
    rows = [(c, u, v, w, 1, 1, "X", 1 / w) for c, u, v in rows for w in [rng.randint(2, 10) / 10]]
    return spark.createDataFrame(rows, "case_id int, u string, v string, weight double, observations long, n_evidence long, relation_types string, distance double").cache()


def no_rounds(*_, **__):
    raise AssertionError("parts that fit a kernel went by rounds")


def test_parts_of_large_cases_go_to_kernels(spark, parted_edges, monkeypatch):
    for name in ("blocks", "communities", "eigenvector"):
        monkeypatch.setattr(graph.by_joins, name, no_rounds)
    monkeypatch.setattr(graph, "far_path", no_rounds)
    monkeypatch.setattr(graph, "BIN_EDGES", 20)
    e, cut = parted_edges, shared_checkpoint(spark)
    pick = lambda df: sorted((r.case_id, r.node) for r in df.where("is_cut").collect())
    assert pick(graph.node_measures(e, cut, most_nodes=12)) == pick(graph.node_measures(e)) != []
    pairs = lambda df: sorted((r.case_id, r.u, r.v) for r in df.collect())
    assert pairs(graph.bridge_edges(e, cut, most_nodes=12)) == pairs(graph.bridge_edges(e)) != []
    score = lambda df: {(r.case_id, r.node): r.score for r in df.collect()}
    for rounds, close in ((100, 1e-5), (500, 1e-4), (3, 1e-9)):
        assert score(graph.eigenvector(e, rounds, close, cut, 12)) == pytest.approx(score(graph.eigenvector(e, rounds, close)), abs=2e-6)
    for a, b in (("n1", "n4"), ("n1", "n104"), ("n1", "gone"), ("gone", "lost"), ("n700", "n708")):
        assert sorted(graph.shortest_path(e, a, b, cut, 40).collect()) == sorted(graph.shortest_path(e, a, b).collect())
    got, kernel = graph.communities(e, cut, 12).toPandas(), graph.communities(e).toPandas()
    for case, pdf in e.toPandas().groupby("case_id"):
        a, b = (dict(x[x.case_id == case][["node", "community"]].values.tolist()) for x in (got, kernel))
        assert a.keys() == b.keys() and modularity(pdf, a) > 0.95 * modularity(pdf, b)
        assert all(a[c] == c <= x for x, c in a.items())


def test_components_by_contraction(spark):
    rng = random.Random(4)
    rows = [(c, u, v) for c in (0, 1) for u, v in (rng.sample(range(60), 2) for _ in range(45))] + [(2, i, i + 1) for i in range(90, 40, -1)]
    want = {}
    for c, u, v in rows:
        want.setdefault((c, u), {u}), want.setdefault((c, v), {v})
        both = want[c, u] | want[c, v]
        for x in both:
            want[c, x] = both
    got = graph.node_components(spark.createDataFrame(rows, "case_id int, u int, v int"), shared_checkpoint(spark)).collect()
    assert sorted((r.case_id, r.node, r.component) for r in got) == sorted((c, x, min(s)) for (c, x), s in want.items())


def modularity(pdf, label):
    total, inner, tot = 2 * pdf.weight.sum(), 0.0, {}
    for u, v, w in zip(pdf.u, pdf.v, pdf.weight):
        inner += 2 * w * (label[u] == label[v])
        for x in (u, v):
            tot[label[x]] = tot.get(label[x], 0) + w
    return inner / total - sum(t * t for t in tot.values()) / total**2


def test_communities_by_joins_are_as_good_as_the_kernels(spark, odd_edges):
    few = odd_edges.where("case_id IN (2, 3, 5)")
    by_joins, kernel = graph.communities(few, shared_checkpoint(spark), 2).toPandas(), graph.communities(few).toPandas()
    assert len(by_joins) == len(kernel)
    for case, pdf in few.toPandas().groupby("case_id"):
        a, b = (dict(x[x.case_id == case][["node", "community"]].values.tolist()) for x in (by_joins, kernel))
        assert modularity(pdf, a) > 0.9 * modularity(pdf, b)
        assert all(a[c] == c <= x for x, c in a.items())


def test_large_cases_without_checkpoint_are_whole(spark):
    n = graph.MOST_NODES + 100
    e = spark.range(1, n).selectExpr("0 AS case_id", "int(id) AS u", "int(id) + 1 AS v", "1.0D AS weight", "1.0D AS distance")
    assert graph.bridge_edges(e).count() == n - 1 and graph.communities(e).count() == graph.eigenvector(e, 3).count() == n
    assert graph.node_measures(e).where("is_cut").count() == n - 2


def test_far_paths_have_no_round_limit_and_break_ties_like_the_kernel(spark):
    chain = [(0, i, i + 1, 1.0, 1.0) for i in range(1, 67)]
    ties = [(1, 1, 9, 1.0, 1.0), (1, 9, 67, 1.0, 2.0), (1, 1, 2, 1.0, 1.0), (1, 2, 3, 1.0, 1.0), (1, 3, 67, 1.0, 1.0), (1, 1, 67, 0.2, 5.0), (1, 1, 3, 1.0, 2.0)]
    e = spark.createDataFrame(chain + ties, "case_id int, u int, v int, weight double, distance double").cache()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        far = sorted(graph.shortest_path(e, 1, 67, shared_checkpoint(spark), most_nodes=2).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert far == sorted(graph.shortest_path(e, 1, 67).collect())
    assert far[0].found and far[0].distance == 66 and far[1].path == "1>2>3>67"


@pytest.fixture(scope="module")
def dense_edges(spark):
    """Two connected cases of eight dense clumps in a row, of which neighbours share a node, with a pendant node each."""
    rng = random.Random(5)
    rows = set()
    for c in (0, 1):
        for k in range(8):
            clump = range(20 * k, 20 * k + 21)
            rows |= {(c, *sorted(rng.sample(clump, 2))) for _ in range(400)} | {(c, clump[0], clump[1]), (c, clump[-2], clump[-1]), (c, clump[7], 900 + k)}
    return spark.createDataFrame([(c, f"n{u}", f"n{v}", 1.0) for c, u, v in sorted(rows)], "case_id int, u string, v string, distance double").cache()


@pytest.mark.parametrize("most_edges", [10_000, 800])
def test_connected_large_cases_are_thinned_and_not_sent_by_rounds(spark, dense_edges, monkeypatch, most_edges):
    monkeypatch.setattr(graph.by_joins, "blocks", no_rounds)
    monkeypatch.setattr(graph, "KERNEL_NODES", 100)
    monkeypatch.setattr(graph, "MOST_NODES", 50)
    monkeypatch.setattr(graph, "CHUNK_EDGES", most_edges)
    cut = shared_checkpoint(spark)
    got = graph.node_measures(dense_edges, cut, 50).where("is_cut").collect()
    want = [(c, n) for c, part in dense_edges.toPandas().groupby("case_id") for n in graph.cuts(graph._adjacency(part))[0]]
    assert sorted((r.case_id, r.node) for r in got) == sorted(want) != []


def test_thinned_edges_connect_what_all_edges_connect_without_any_one_node():
    import numpy as np

    def parts(n, edges, gone):
        adj = {x: [] for x in range(n)}
        for a, b in edges:
            if gone not in (a, b):
                adj[a].append(b), adj[b].append(a)
        label = {}
        for root in adj:
            todo = [root]
            while todo:
                if (x := todo.pop()) not in label:
                    label[x] = root
                    todo += adj[x]
        return label

    rng = random.Random(11)
    for _ in range(150):
        shared = rng.randint(0, 1)  # two clumps, with a node in common or without
        edges = sorted({tuple(sorted(rng.sample(range(c * (9 - shared), c * (9 - shared) + 9), 2))) for c in (0, 1) for _ in range(60)})
        n = 18 - shared
        a, b = np.array(edges).T
        few = graph._deciding(n, a, b)
        assert len(few) < len(edges) and len(few) <= 2 * n
        for gone in range(-1, n):
            assert parts(n, edges, gone) == parts(n, [edges[i] for i in few], gone)


def test_parts_from_forests_of_shares_are_the_components(spark):
    rng = random.Random(6)
    rows = sorted({(c, *sorted(rng.sample(range(20 * k, 20 * k + 20), 2))) for c in (0, 1) for k in range(6) for _ in range(60)})
    e, cut = spark.createDataFrame([(c, f"n{u}", f"n{v}") for c, u, v in rows], "case_id int, u string, v string"), shared_checkpoint(spark)

    def groups(df):
        out = {}
        for r in df.collect():
            out.setdefault((r.case_id, r.component), set()).add(r.node)
        return sorted(map(sorted, out.values()))

    assert groups(graph.connected_parts(e, cut, 150)) == groups(graph.connected_parts(e, cut)) == groups(graph.node_components(e, cut))


def test_bridges_of_large_cases_come_from_thinned_shares(spark, dense_edges, monkeypatch):
    for name in ("node_components", "connected_parts"):
        monkeypatch.setattr(graph, name, no_rounds)
    monkeypatch.setattr(graph.by_joins, "blocks", no_rounds)
    monkeypatch.setattr(graph, "CHUNK_EDGES", 800)
    got = graph.bridge_edges(dense_edges, shared_checkpoint(spark)).collect()
    want = [(c, *e) for c, part in dense_edges.toPandas().groupby("case_id") for e in graph.cuts(graph._adjacency(part))[1]]
    assert sorted((r.case_id, r.u, r.v) for r in got) == sorted(want) != []


def test_connected_cases_of_many_nodes_go_to_kernels(spark, monkeypatch):
    for name in ("communities", "eigenvector"):
        monkeypatch.setattr(graph.by_joins, name, no_rounds)
    monkeypatch.setattr(graph, "far_path", no_rounds)
    monkeypatch.setattr(graph, "node_components", no_rounds)
    n, cut = 21_000, shared_checkpoint(spark)
    e = spark.range(1, n).selectExpr("0 AS case_id", "int(id) AS u", "int(id) + 1 AS v", "1.0D AS weight", "1.0D AS distance")
    assert graph.communities(e, cut).count() == graph.eigenvector(e, 3, checkpoint=cut).count() == n
    assert graph.shortest_path(e, 5, 300, cut).first().distance == 295


def test_edges_dealt_by_evidence_are_summed_up_where_they_lie(spark, sf_dir):
    r = standins.relations(spark, sf_dir).repartition(3, "evidence_id")
    rows = lambda df: sorted(map(tuple, df.collect()))
    dealt, again = graph.build_edges(r, parts=3, dealt=True), graph.build_edges(r, parts=3)
    exchanges = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression")
    assert rows(dealt) == rows(again) and exchanges(dealt) < exchanges(again)


def test_betweenness_of_few_nodes_is_exact_whatever_their_edges(spark, odd_edges, monkeypatch):
    want = sorted(map(tuple, graph.node_measures(odd_edges).collect()))
    monkeypatch.setattr(graph, "KERNEL_EDGES", 3)
    assert sorted(map(tuple, graph.node_measures(odd_edges).collect())) == want
    assert sorted(map(tuple, graph.node_measures(odd_edges, shared_checkpoint(spark)).collect())) == want


def test_betweenness_by_rows_of_the_matrix():
    rng = random.Random(9)
    for n, m in ((1, 0), (12, 14), (40, 500), (40, 780)):
        adj = {x: {} for x in range(n)}
        for u, v in rng.sample([(u, v) for u in range(n) for v in range(u)], m):
            adj[u][v] = adj[v][u] = 1 / rng.choice([0.5, 0.75, 1.0])
        assert graph._dense_brandes(adj) == pytest.approx(graph._brandes(adj), abs=1e-9)
