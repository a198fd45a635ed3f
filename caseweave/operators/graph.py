"""The weighted case graph and what is read off it.

Edges are (case_id, u, v, weight, observations, evidence, types) with u < v. Grouped kernels (betweenness, cut
nodes, communities, paths) take one case at a time, in arrays. Given a `checkpoint` function (see lineage), cases of over
`most_nodes` nodes or `KERNEL_EDGES` edges are cut into their connected parts: parts within these limits are dealt to
kernels, larger parts go by rounds of joins (see rounds), with the same results. Cut nodes and bridges are looked for in the
edges that decide on them, at most two a node, and connected parts in spanning forests, to which shares of `CHUNK_EDGES` are
thinned out first. The ceiling `MOST_NODES` belongs to betweenness alone: larger cases fall back to degree, which is plain SQL.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rounds as by_joins

MOST_NODES, MIN_WEIGHT = 1_500, 0.01
#: A case of up to so many edges, and so of twice as many nodes at most, fits a small part of a task's memory in arrays.
KERNEL_NODES, KERNEL_EDGES = 4_000_000, 2_000_000
#: Edges of the small parts of a large case that a kernel takes at once, about.
BIN_EDGES = 50_000
#: Edges that one task thins out, in arrays, about.
CHUNK_EDGES = 2_000_000


def build_edges(relations: DataFrame, min_confidence: float = 0.0, types: list[str] | None = None, verified_only: bool = False, parts: int | None = None, dealt: bool = False) -> DataFrame:
    """Unordered pairs of unrejected relations: case_id, u, v, weight (best confidence), observations, n_evidence,
    relation_types, distance. Self edges drop out. Each pair's evidence is summed up first; with `parts`, in so many tasks. dealt: as in
    by_evidence."""
    rows = relations.where((F.coalesce("status", F.lit("")) != "rejected") & (F.col("confidence") >= min_confidence) & F.expr("subject <> object"))
    if types:
        rows = rows.where(F.col("relation_type").isin(*types))
    if verified_only:
        rows = rows.where(F.col("status") == "human_verified")
    rows = rows.select("case_id", F.least("subject", "object").alias("u"), F.greatest("subject", "object").alias("v"), "evidence_id", "confidence", "relation_type")
    out = by_evidence(rows, ["case_id", "u", "v"], parts, "relation_type", dealt).select(
        "case_id", "u", "v", F.col("confidence").alias("weight"), "observations", "n_evidence", F.array_join(F.array_sort("relation_type"), ",").alias("relation_types")
    )
    return out.withColumn("distance", 1 / F.greatest("weight", F.lit(MIN_WEIGHT)))


def by_evidence(rows: DataFrame, keys: list[str], parts: int | None = None, values: str | None = None, dealt: bool = False) -> DataFrame:
    """Per key: best confidence, observations, n_evidence and, where asked for, the set of a column's values. rows: keys,
    evidence_id, confidence. A key's evidence is dealt out and summed up before it meets under the key, both in `parts` tasks where
    that is given, so that a task's memory is that of its share and not of the input. dealt: the rows lie by evidence already, in tasks
    of bounded size, and are summed up where they lie."""
    deal = lambda d, by: d.repartition(parts, *by) if parts else d
    best, n, seen = F.max("confidence").alias("confidence"), F.count("*").alias("observations"), [F.collect_set(values).alias(values)] if values else []
    per = (rows if dealt else deal(rows, [*keys, "evidence_id"])).groupBy(*keys, "evidence_id").agg(best, n, *seen)
    every = [F.array_distinct(F.flatten(F.collect_set(values))).alias(values)] if values else []
    return deal(per, keys).groupBy(*keys).agg(best, F.sum("observations").alias("observations"), F.count("evidence_id").alias("n_evidence"), *every)


def profile_connections(relations: DataFrame, parts: int | None = None) -> DataFrame:
    """Each party's relations to each other one, over all cases: node, other, confidence, observations, n_evidence. A pair is summed
    up once for both its ends; a party's relations to itself are seen from both. parts: as in build_edges."""
    up = F.col("subject") <= F.col("object")
    first, second = F.when(up, F.col("subject")).otherwise(F.col("object")), F.when(up, F.col("object")).otherwise(F.col("subject"))
    pairs = by_evidence(relations.select(first.alias("u"), second.alias("v"), "evidence_id", "confidence"), ["u", "v"], parts)
    alone, end = F.col("u").eqNullSafe(F.col("v")), lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("other"))
    seen = F.explode(F.when(alone, F.array(end("u", "v"))).otherwise(F.array(end("u", "v"), end("v", "u"))))
    observations = F.when(alone, 2 * F.col("observations")).otherwise(F.col("observations")).alias("observations")
    return pairs.select(seen.alias("_e"), "confidence", observations, "n_evidence").select("_e.node", "_e.other", "confidence", "observations", "n_evidence")


def ends(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends: case_id, node, other and the edge's columns."""
    turned = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"))))
    rest = [c for c in edges.columns if c not in ("u", "v")]
    return edges.select(*rest, turned.alias("_e")).select(*rest, "_e.node", "_e.other")


def degree_centrality(edges: DataFrame) -> DataFrame:
    """case_id, node, degree, centrality: degree / (n - 1), and 1 for a lone node."""
    deg = ends(edges).groupBy("case_id", "node").agg(F.count("*").alias("degree"))
    n = deg.groupBy(F.col("case_id").alias("_c")).agg(F.count("*").alias("n"))
    out = deg.join(n, F.col("case_id") == F.col("_c"))
    return out.select("case_id", "node", "degree", F.when(F.col("n") > 1, F.bround(F.col("degree") / (F.col("n") - 1), 6)).otherwise(1.0).alias("centrality"))


def node_weight(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("case_id", "node").agg(F.sum("observations").alias("weight"))


def ego_subgraph(edges: DataFrame, root: str | int, hops: int = 1) -> DataFrame:
    """Induced edges of the nodes within 1 to 3 hops of a root, in every case that has it."""
    hops, both = min(3, max(1, hops)), ends(edges).select("case_id", "node", "other")
    near = both.where(F.col("node") == root).select("case_id", "node").distinct()
    for _ in range(hops):
        step = both.join(near, ["case_id", "node"]).select("case_id", F.col("other").alias("node"))
        near = near.unionByName(step).distinct()
    u, v = near.select("case_id", F.col("node").alias("u")), near.select("case_id", F.col("node").alias("v"))
    return edges.join(u, ["case_id", "u"], "left_semi").join(v, ["case_id", "v"], "left_semi")


def bfs_levels(edges: DataFrame, root: str | int, depth: int = 6) -> DataFrame:
    """Nodes reached from a root with their level, `depth` at most."""
    both = ends(edges).select("case_id", "node", "other")
    seen = both.where(F.col("node") == root).select("case_id", "node", F.lit(0).alias("level")).distinct()
    front = seen
    for level in range(1, depth + 1):
        step = both.join(front.select("case_id", "node"), ["case_id", "node"]).select("case_id", F.col("other").alias("node")).distinct()
        front = step.join(seen.select("case_id", "node"), ["case_id", "node"], "left_anti").withColumn("level", F.lit(level))
        seen = seen.unionByName(front)
    return seen


def all_levels(edges: DataFrame, roots: DataFrame | None, checkpoint) -> DataFrame:
    """Every node of every case with its level from the case's root; those that the root doesn't reach stand one level below the
    deepest. roots: case_id, node; by default, and in cases without one, the node of most edges, the smallest of equals."""
    both = checkpoint(ends(edges).select("case_id", "node", "other"))
    deg = both.groupBy("case_id", "node").agg(F.count("*").alias("d"))
    busiest = deg.groupBy("case_id").agg(F.min(F.struct((-F.col("d")).alias("less"), "node")).alias("b")).select("case_id", F.col("b.node").alias("node"))
    if roots is not None:
        roots = roots.join(deg, ["case_id", "node"], "left_semi")
        busiest = roots.unionByName(busiest.join(roots.select("case_id"), "case_id", "left_anti"))
    front = checkpoint(busiest.withColumn("level", F.lit(0)))
    levels = [front]
    while True:
        # a neighbour lies one level off at most
        seen = front.select("case_id", "node") if len(levels) < 2 else front.select("case_id", "node").unionByName(levels[-2].select("case_id", "node"))
        step = both.join(front.select("case_id", "node"), ["case_id", "node"]).select("case_id", F.col("other").alias("node")).distinct()
        front = checkpoint(step.join(seen, ["case_id", "node"], "left_anti").withColumn("level", F.lit(len(levels))))
        if not front.take(1):
            break
        levels.append(front)
    seen = by_joins._gather(levels, checkpoint)
    deepest = seen.groupBy("case_id").agg(F.max("level").alias("most"))
    out = deg.select("case_id", "node").join(seen, ["case_id", "node"], "left").join(deepest, "case_id")
    return out.select("case_id", "node", F.coalesce("level", F.col("most") + 1).alias("level"))


def one_hop(edges: DataFrame, focus: str | int, types: list[str] | None = None) -> DataFrame:
    """The induced edges of a focus and its neighbours, of the given relation types alone."""
    rows = edges
    if types:
        rows = edges.where(F.arrays_overlap(F.split("relation_types", ","), F.array(*map(F.lit, types))))
    return ego_subgraph(rows, focus, 1)


def connections(edges: DataFrame, source, target, relations: DataFrame, checkpoint) -> DataFrame:
    """How two parties of each case are joined: their relations where there are any (how: direct), else the shortest path (how:
    path) or why there is none (how: none). case_id, how, detail, weakest."""
    ends_ = (F.col("subject") == source) & (F.col("object") == target) | (F.col("subject") == target) & (F.col("object") == source)
    direct = relations.where(ends_ & (F.coalesce("status", F.lit("")) != "rejected")).groupBy("case_id").agg(
        F.array_join(F.array_sort(F.collect_set("relation_type")), ",").alias("detail"), F.max("confidence").cast("double").alias("weakest")
    )
    found = shortest_path(edges.join(direct.select("case_id"), "case_id", "left_anti"), source, target, checkpoint)
    how = F.when(F.col("found"), "path").otherwise("none")
    rest = found.select("case_id", how.alias("how"), F.coalesce("path", "reason").alias("detail"), "weakest")
    return direct.select("case_id", F.lit("direct").alias("how"), "detail", "weakest").unionByName(rest)


def important(edges: DataFrame, checkpoint, metric: str = "degree", kind=None, top: int = 10) -> DataFrame:
    """The `top` entities of each case by degree, betweenness or eigenvector score, ranked after the filter `kind` (a condition on
    node): case_id, rank, node, score, connections, n_evidence, communities_linked (of its neighbours), is_bridge (a cut node)."""
    from .rollups import top_per

    edges = checkpoint(edges.select("case_id", "u", "v", "weight", "distance", "n_evidence"))
    measures = checkpoint(node_measures(edges, checkpoint))
    home = checkpoint(communities(edges, checkpoint))
    degree = degree_centrality(edges).select("case_id", "node", F.col("degree").alias("connections"), F.col("centrality").alias("degree_score"))
    rows = measures.join(degree, ["case_id", "node"])
    if metric == "eigenvector":
        rows = rows.join(eigenvector(edges, checkpoint=checkpoint), ["case_id", "node"])
    else:
        rows = rows.withColumn("score", F.col("betweenness" if metric == "betweenness" else "degree_score"))
    best = checkpoint(top_per(rows.where(kind) if kind is not None else rows, ["case_id"], [F.desc("score"), F.asc("node")], top))
    near = ends(edges).join(best.select("case_id", "node"), ["case_id", "node"])
    linked = near.join(home.select("case_id", F.col("node").alias("other"), "community"), ["case_id", "other"])
    reach = linked.groupBy("case_id", "node").agg(F.count_distinct("community").alias("communities_linked"), F.sum("n_evidence").alias("n_evidence"))
    out = best.join(reach, ["case_id", "node"])
    return out.select("case_id", "rank", "node", "score", "connections", "n_evidence", "communities_linked", F.col("is_cut").alias("is_bridge"))


def node_components(edges: DataFrame, checkpoint) -> DataFrame:
    """case_id, node, component (its smallest node) by contraction: each round every node goes to the smallest neighbour of its
    smallest neighbour, and the edges between what is left go on to the next, until none is left.

    checkpoint: a function that cuts lineage, such as DataFrame.checkpoint."""
    edges = checkpoint(edges.select("case_id", "u", "v"))
    labels = None
    while labels is None or edges.take(1):
        both = ends(edges).select("case_id", "node", "other")
        low = checkpoint(both.groupBy("case_id", "node").agg(F.least("node", F.min("other")).alias("label")))
        jump = low.select("case_id", F.col("node").alias("label"), F.col("label").alias("far"))
        to = checkpoint(low.join(jump, ["case_id", "label"]).select("case_id", "node", F.col("far").alias("label")))
        if labels is None:
            labels = to
        else:
            on = to.select("case_id", F.col("node").alias("label"), F.col("label").alias("far"))
            labels = checkpoint(labels.join(on, ["case_id", "label"], "left").select("case_id", "node", F.coalesce("far", "label").alias("label")))
        a, b = (to.select("case_id", F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("u", "v"))
        left = edges.join(a, ["case_id", "u"]).join(b, ["case_id", "v"]).where("_u <> _v")
        edges = checkpoint(left.select("case_id", F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct())
    return labels.select("case_id", "node", F.col("label").alias("component"))


def _parts(edges: DataFrame, checkpoint, most_nodes: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges of the connected parts of up to `most_nodes` nodes and KERNEL_EDGES edges with `_bin`, which deals a case's parts to
    kernels, and `_n`, the nodes of the case; and the edges of larger parts (None without any)."""
    home = checkpoint(connected_parts(edges, checkpoint).withColumnRenamed("component", "_part"))
    rows = checkpoint(edges.join(home.withColumnRenamed("node", "u"), ["case_id", "u"]))
    key = ["case_id", "_part"]
    sizes = home.groupBy(key).agg(F.count("*").alias("n")).join(rows.groupBy(key).agg(F.count("*").alias("m")), key)
    sizes = sizes.withColumn("_fits", (F.col("n") <= most_nodes) & (F.col("m") <= KERNEL_EDGES))
    total = sizes.groupBy("case_id").agg(F.sum("n").alias("_n"), F.ceil(F.sum(F.when(F.col("_fits"), F.col("m"))) / BIN_EDGES).alias("_bins"))
    dealt = checkpoint(sizes.join(total, "case_id").select(*key, "_fits", "_n", F.pmod(F.xxhash64("_part"), F.col("_bins")).alias("_bin")))
    placed = rows.join(dealt, key)
    near = placed.where("_fits").select(*edges.columns, "_bin", "_n")
    return near, placed.where("NOT _fits").select(*edges.columns) if dealt.where("NOT _fits").take(1) else None


def _adjacency(pdf: pd.DataFrame) -> dict:
    out: dict = defaultdict(dict)
    for u, v, d in zip(pdf.u, pdf.v, pdf.distance, strict=True):
        out[u][v] = out[v][u] = d
    return out


def _brandes(adj: dict) -> dict:
    """Weighted betweenness, normalised for an undirected graph."""
    score = dict.fromkeys(adj, 0.0)
    for s in adj:
        order, preds, sigma, dist, best = [], defaultdict(list), defaultdict(float), {}, {s: 0.0}
        sigma[s], heap = 1.0, [(0.0, 0, s)]
        tick = 0
        while heap:
            d, _, x = heappop(heap)
            if x in dist:
                continue
            dist[x] = d
            order.append(x)
            for y, w in adj[x].items():
                nd = d + w
                if y not in dist and nd < best.get(y, float("inf")) - 1e-12:
                    best[y], sigma[y], preds[y] = nd, sigma[x], [x]
                    tick += 1
                    heappush(heap, (nd, tick, y))
                elif y not in dist and abs(nd - best[y]) <= 1e-12:
                    sigma[y] += sigma[x]
                    preds[y].append(x)
        delta = defaultdict(float)
        for y in reversed(order):
            for x in preds[y]:
                delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
            if y != s:
                score[y] += delta[y]
    n = len(adj)
    return {x: v / ((n - 1) * (n - 2)) if n > 2 else 0.0 for x, v in score.items()}


def _dense_brandes(adj: dict) -> dict:
    """_brandes by rows of the distance matrix: of a dense graph every step is one pass over a row."""
    n, at = len(adj), {x: i for i, x in enumerate(adj)}
    apart, score = np.full((n, n), np.inf), np.zeros(n)
    for x, ys in adj.items():
        apart[at[x], [at[y] for y in ys]] = list(ys.values())
    for s in range(n):
        best, open_, order = np.full(n, np.inf), np.zeros(n), []
        best[s] = 0.0
        while np.isfinite(best[x := int(np.argmin(best + open_))]) and not open_[x]:
            open_[x] = np.inf
            order.append(x)
            best = np.minimum(best, np.where(open_ > 0, best, best[x] + apart[x]))
        dist, sigma, delta, place = best[order], np.zeros(len(order)), np.zeros(len(order)), np.array(order)
        sigma[0], preds = 1.0, [None]
        for k in range(1, len(order)):
            preds.append(np.flatnonzero(np.abs(dist[:k] + apart[place[:k], place[k]] - dist[k]) <= 1e-12))
            sigma[k] = sigma[preds[k]].sum()
        for k in range(len(order) - 1, 0, -1):
            delta[preds[k]] += sigma[preds[k]] / sigma[k] * (1 + delta[k])
        score[place[1:]] += delta[1:]
    return {x: score[i] / ((n - 1) * (n - 2)) if n > 2 else 0.0 for x, i in at.items()}


def cuts(adj: dict) -> tuple[set, set]:
    """Cut nodes and bridge edges, without recursion."""
    num, low, points, bridges, tick = {}, {}, set(), set(), 0
    for root in adj:
        if root in num:
            continue
        num[root] = low[root] = tick = tick + 1
        stack, children = [(root, None, iter(adj[root]))], 0
        while stack:
            x, parent, it = stack[-1]
            for y in it:
                if y == parent:
                    continue
                if y in num:
                    low[x] = min(low[x], num[y])
                else:
                    num[y] = low[y] = tick = tick + 1
                    stack.append((y, x, iter(adj[y])))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[x])
                    if low[x] > num[parent]:
                        bridges.add((min(x, parent), max(x, parent)))
                    if parent == root:
                        children += 1
                    elif low[x] >= num[parent]:
                        points.add(parent)
        if children > 1:
            points.add(root)
    return points, bridges


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the edges (a, b) of a spanning forest of the nodes 0 to n - 1, and each node's component. In a round every
    component that borders on one of lower rank joins it; ranks are drawn anew, so that half of them do."""
    rng, label, used, idx, x, y = np.random.default_rng(7), np.arange(n), [], np.arange(len(a)), a, b
    while idx.size:
        rank = rng.permutation(n)
        up = rank[x] > rank[y]
        pick = np.full(n, -1)
        pick[np.where(up, x, y)] = np.arange(idx.size)
        joining = np.flatnonzero(pick >= 0)
        taken = pick[joining]
        used.append(idx[taken])
        to = np.arange(n)
        to[joining] = np.where(up, y, x)[taken]
        while not np.array_equal(to, far := to[to]):
            to = far
        label, x, y = to[label], to[x], to[y]
        left = x != y
        x, y, idx = x[left], y[left], idx[left]
    return np.concatenate(used) if used else idx, label


def _neighbours(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each node's neighbours begin, the neighbours in the order of their nodes, and the edges that lead to them."""
    ends = np.concatenate([a, b])
    order = np.argsort(ends, kind="stable")
    begin = np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])
    return begin, np.concatenate([b, a])[order], order % max(len(a), 1)


def _deciding(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of at most two edges a node that keep every set of nodes connected which the edges (a, b) connect once any one node
    is gone: a breadth-first forest, and a spanning forest of the other edges (Cheriyan, Kao and Thurimella, 1993). So they
    stand for these edges within any larger graph."""
    if len(a) <= 2 * n:
        return np.arange(len(a))
    begin, other, edge = _neighbours(n, a, b)
    front = np.unique(_forest(n, a, b)[1], return_index=True)[1]
    via, seen = np.full(n, -1), np.zeros(n, dtype=bool)
    seen[front] = True
    while front.size:
        many = begin[front + 1] - begin[front]
        at = np.repeat(begin[front] - np.cumsum(many) + many, many) + np.arange(many.sum())
        at = at[~seen[other[at]]][::-1]  # of a node's edges the last one written stays: that of the first in front to meet it
        via[other[at]] = edge[at]
        front = np.unique(other[at])
        seen[front] = True
    kept = np.zeros(len(a), dtype=bool)
    kept[via[via >= 0]] = True
    rest = np.flatnonzero(~kept)
    kept[rest[_forest(n, a[rest], b[rest])[0]]] = True
    return np.flatnonzero(kept)


def _numbered(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes of edges (u, v), and both ends by their places among these."""
    both = pa.chunked_array([*table["u"].chunks, *table["v"].chunks]).combine_chunks().dictionary_encode()
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    at = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return both.dictionary, at[: table.num_rows], at[table.num_rows :]


def _directed(table: pa.Table, natural: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of edges (u, v) in order (else in that of their texts), and by node each edge from both its ends: begin, the
    neighbours by their places among the nodes, and the edges' rows. Of edges between the same nodes the last one counts."""
    nodes, a, b = _numbered(table)
    order = pc.array_sort_indices(nodes if natural else nodes.cast(pa.string()))
    rank = np.empty(len(nodes), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(nodes))
    x, y, row = np.stack([rank[a], rank[b]], 1).ravel(), np.stack([rank[b], rank[a]], 1).ravel(), np.repeat(np.arange(len(a)), 2)
    by = np.argsort(x * len(nodes) + y, kind="stable")
    x, y, row = x[by], y[by], row[by]
    last = np.append((x[1:] != x[:-1]) | (y[1:] != y[:-1]), True)
    begin = np.concatenate([[0], np.cumsum(np.bincount(x[last], minlength=len(nodes)))])
    return nodes.take(order), begin, y[last], row[last]


def _dealt(edges: DataFrame, *by: str) -> DataFrame:
    """Edges grouped by case or bin, in so many tasks that few keys share one."""
    return edges.repartition(8 * edges.sparkSession.sparkContext.defaultParallelism, *by).groupBy(*by)


def _thinned(edges: DataFrame, by: list[str], tasks: int, deciding) -> DataFrame:
    """Of the edges of each key `by` those at the places that `deciding` (of nodes and both ends) returns."""

    def kernel(table: pa.Table) -> pa.Table:
        nodes, a, b = _numbered(table)
        return table.select(["case_id", "u", "v"]).take(pa.array(deciding(len(nodes), a, b)))

    return edges.repartition(tasks, *by).groupBy(*by).applyInArrow(kernel, edges.select("case_id", "u", "v").schema)


def _solved(edges: DataFrame, by: list[str], tasks: int, kernel, schema) -> DataFrame:
    """What the kernel makes of the edges of each key `by`."""
    return edges.select(*by, "u", "v").repartition(tasks, *by).groupBy(*by).applyInArrow(kernel, schema)


def _by_shares(edges: DataFrame, checkpoint, deciding, kernel, schema, stuck_by, most_edges: int) -> DataFrame:
    """What `kernel` makes of each case, which may be seen from the edges that `deciding` leaves of any share. A case's edges are
    dealt to shares of about `most_edges`, each of which keeps the edges that decide, until what is left of the case is one share.
    Cases that stop shrinking go to `stuck_by` (of edges and tasks, a list of frames)."""
    key, found = ["case_id"], []
    edges = edges.select("case_id", "u", "v")
    sizes = checkpoint(edges.groupBy(key).agg(F.count("*").alias("_m")))
    while total := sizes.agg(F.sum("_m")).first()[0]:
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, 4 * -(-total // most_edges))
        near, far = sizes.where(F.col("_m") <= most_edges), sizes.where(F.col("_m") > most_edges)
        if near.take(1):
            found.append(checkpoint(_solved(edges.join(near, key, "left_semi"), key, tasks, kernel, schema)))
        if not far.take(1):
            break
        shares = F.ceil(F.col("_m") / most_edges)
        dealt = edges.join(far, key).select(*edges.columns, F.pmod(F.xxhash64("u"), shares).alias("_share"))
        # the edges of a node that fill more than a share by themselves are dealt by their other ends
        full = checkpoint(dealt.groupBy("case_id", "_share").agg(F.ceil(F.count("*") / (2 * most_edges)).alias("_full")))
        dealt = dealt.join(full, ["case_id", "_share"]).withColumn("_full", F.pmod(F.xxhash64("v"), F.col("_full")))
        edges = checkpoint(_thinned(dealt, ["case_id", "_share", "_full"], tasks, deciding))
        left = edges.groupBy(key).agg(F.count("*").alias("_left"))
        left = checkpoint(left.join(far, key).withColumn("_stuck", (F.col("_left") > most_edges) & (F.col("_left") > 0.9 * F.col("_m"))))
        stuck, sizes = left.where("_stuck"), left.where("NOT _stuck").select("case_id", F.col("_left").alias("_m"))
        if stuck.take(1):
            found += stuck_by(edges.join(stuck, key, "left_semi").select("case_id", "u", "v"), tasks)
    return reduce(DataFrame.unionByName, found) if found else edges.sparkSession.createDataFrame([], schema)


def _case_of(table: pa.Table, n: int) -> pa.Array:
    return pa.repeat(table["case_id"][0], n)


def _forest_edges(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _forest(n, a, b)[0]


def connected_parts(edges: DataFrame, checkpoint, most_edges: int | None = None) -> DataFrame:
    """case_id, node, component (one of its nodes): node_components from spanning forests of shares of the edges."""

    def kernel(table: pa.Table) -> pa.Table:
        nodes, a, b = _numbered(table)
        return pa.table({"case_id": _case_of(table, len(nodes)), "node": nodes, "component": nodes.take(pa.array(_forest(len(nodes), a, b)[1]))})

    schema = edges.select("case_id", F.col("u").alias("node"), F.col("u").alias("component")).schema
    contracted = lambda rest, _: [node_components(rest, checkpoint)]
    return _by_shares(edges, checkpoint, _forest_edges, kernel, schema, contracted, most_edges or CHUNK_EDGES)


def _cuts_of(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, tuple[set, set]]:
    """The nodes, the edges that decide on cuts (rows and both ends), and cuts by the nodes' places."""
    nodes, a, b = _numbered(table)
    few = _deciding(len(nodes), a, b)
    a, b = a[few], b[few]
    begin, other, _ = (x.tolist() for x in _neighbours(len(nodes), a, b))
    return nodes, few, a, b, cuts({x: other[begin[x] : begin[x + 1]] for x in range(len(nodes))})


def cut_nodes(edges: DataFrame, checkpoint, most_edges: int | None = None, most_nodes: int | None = None) -> DataFrame:
    """case_id, node of the nodes whose removal disconnects others of their case, by shares of about `most_edges` (CHUNK_EDGES). A case
    that stops shrinking is cut into connected parts: parts of up to `most_nodes` (KERNEL_NODES) nodes go to kernels, larger ones
    by rounds of joins."""

    def kernel(table: pa.Table) -> pa.Table:
        nodes, *_, (points, _) = _cuts_of(table)
        found = nodes.take(pa.array(sorted(points), pa.int64()))
        return pa.table({"case_id": _case_of(table, len(found)), "node": found})

    schema = edges.select("case_id", F.col("u").alias("node")).schema

    def stuck_by(rest: DataFrame, tasks: int) -> list[DataFrame]:
        parts, rest = _parts(rest, checkpoint, most_nodes or KERNEL_NODES)
        near = [_solved(parts, ["case_id", "_bin"], tasks, kernel, schema)]
        return near if rest is None else [*near, by_joins.cut_nodes(by_joins.blocks(rest, checkpoint))]

    return _by_shares(edges, checkpoint, _deciding, kernel, schema, stuck_by, most_edges or CHUNK_EDGES)


def _by_size(edges: DataFrame, most_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Edges of the cases of up to `most_nodes` nodes and KERNEL_EDGES edges, and of the larger ones."""
    same, large = F.col("case_id") == F.col("_c"), F.col("m") > KERNEL_EDGES
    if most_nodes >= 2 * KERNEL_EDGES:  # edges bound the nodes
        sizes = edges.groupBy(F.col("case_id").alias("_c")).agg(F.count("*").alias("m"))
    else:
        sizes = ends(edges).groupBy(F.col("case_id").alias("_c")).agg(F.count_distinct("node").alias("n"), (F.count("*") / 2).alias("m"))
        large = large | (F.col("n") > most_nodes)
    big = sizes.where(large).select("_c")
    return edges.join(big, same, "left_anti"), edges.join(big, same, "left_semi")


def node_measures(edges: DataFrame, checkpoint=None, most_nodes: int = MOST_NODES) -> DataFrame:
    """case_id, node, betweenness, is_cut. Betweenness of cases of over `most_nodes` nodes is their degree centrality, however many
    edges they have."""
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def measured(rows: DataFrame, whole: bool) -> DataFrame:
        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            adj = _adjacency(pdf)
            between = _dense_brandes if len(pdf) > 50 * len(adj) else _brandes
            score, (points, _) = between(adj) if whole else dict.fromkeys(adj), cuts(adj)
            worth = pd.Series([None if score[x] is None else round(score[x], 6) for x in adj], dtype="float64")
            return pd.DataFrame({"case_id": pdf.case_id.iloc[0], "node": list(adj), "betweenness": worth, "is_cut": [x in points for x in adj]})

        schema = f"case_id {kinds['case_id']}, node {kinds['u']}, betweenness double, is_cut boolean"
        return rows.select("case_id", "u", "v", "distance").groupBy("case_id").applyInPandas(kernel, schema)

    if checkpoint is None:
        sizes = ends(edges).groupBy(F.col("case_id").alias("_c")).agg(F.count_distinct("node").alias("n"))
        big, same = sizes.where(F.col("n") > most_nodes).select("_c"), F.col("case_id") == F.col("_c")
        small, large = edges.join(big, same, "left_anti"), edges.join(big, same, "left_semi")
        degree, cut = degree_centrality(large), measured(large, False).where("is_cut").select("case_id", "node")
    else:
        edges = checkpoint(edges.select("case_id", "u", "v", "distance"))
        degree = checkpoint(degree_centrality(edges))
        sizes = degree.groupBy(F.col("case_id").alias("_c")).agg(F.count("*").alias("n"))
        big, same = checkpoint(sizes.where(F.col("n") > most_nodes).select("_c")), F.col("case_id") == F.col("_c")
        small = edges.join(big, same, "left_anti")
        if not big.take(1):
            return measured(small, True)
        few = {"most_edges": most_nodes, "most_nodes": most_nodes} if most_nodes < MOST_NODES else {}
        degree, cut = degree.join(big, same, "left_semi"), cut_nodes(edges.join(big, same, "left_semi"), checkpoint, **few)
    far = degree.select("case_id", "node", F.col("centrality").alias("betweenness")).join(cut.withColumn("is_cut", F.lit(True)), ["case_id", "node"], "left")
    return measured(small, True).unionByName(far.withColumn("is_cut", F.coalesce("is_cut", F.lit(False))))


def bridge_edges(edges: DataFrame, checkpoint=None, most_nodes: int = KERNEL_NODES) -> DataFrame:
    """Edges whose removal disconnects their case. With `checkpoint` by shares, as cut_nodes."""
    schema = edges.select("case_id", "u", "v").schema

    def kernel(table: pa.Table) -> pa.Table:
        _, few, a, b, (_, found) = _cuts_of(table)
        kept = [i for i, x, y in zip(few.tolist(), a.tolist(), b.tolist(), strict=True) if (min(x, y), max(x, y)) in found]
        return table.select(["case_id", "u", "v"]).take(pa.array(kept, pa.int64()))

    def stuck_by(rest: DataFrame, tasks: int) -> list[DataFrame]:
        parts, rest = _parts(rest, checkpoint, most_nodes)
        near = [_solved(parts, ["case_id", "_bin"], tasks, kernel, schema)]
        return near if rest is None else [*near, by_joins.bridges(by_joins.blocks(rest, checkpoint))]

    if checkpoint is None:
        found = edges.select("case_id", "u", "v").groupBy("case_id").applyInArrow(kernel, schema)
    else:
        edges = checkpoint(edges)
        found = _by_shares(edges, checkpoint, _deciding, kernel, schema, stuck_by, CHUNK_EDGES if most_nodes >= KERNEL_NODES else most_nodes)
    return edges.join(found, ["case_id", "u", "v"], "left_semi")


def louvain(begin: np.ndarray, other: np.ndarray, weight: np.ndarray, seed: int = 7, total: float | None = None) -> np.ndarray:
    """Communities by local moves and aggregation until modularity rests: one of its nodes for every node, of which begin, other and
    weight hold the neighbours. total: the weight of all ends, where these nodes are connected parts of a larger graph (no move
    joins parts)."""
    import random

    rng, label, names = random.Random(seed), np.arange(len(begin) - 1), np.arange(len(begin) - 1)
    x = np.repeat(names, np.diff(begin))
    total = total or float(weight.sum()) or 1.0
    while True:
        n = len(names)
        degree = np.bincount(x, weight, n).tolist()
        apart = x != other
        begin, near, far = np.concatenate([[0], np.cumsum(np.bincount(x[apart], minlength=n))]).tolist(), other[apart], weight[apart]
        own, tot, moved, changed = list(range(n)), degree.copy(), True, False
        order = list(range(n))
        rng.shuffle(order)
        while moved:
            moved = False
            for i in order:
                links: dict = {}
                for y, w in zip(near[begin[i] : begin[i + 1]].tolist(), far[begin[i] : begin[i + 1]].tolist()):  # noqa: B905
                    c = own[y]
                    links[c] = links.get(c, 0.0) + w
                home, d = own[i], degree[i]
                tot[home] -= d
                best, gain = home, links.get(home, 0.0) - tot[home] * d / total
                gains = [w - tot[c] * d / total for c, w in links.items()]
                if max(gains, default=gain) > gain + 1e-12:
                    for c, g in sorted(zip(links, gains)):  # noqa: B905
                        if g > gain + 1e-12:
                            best, gain = c, g
                tot[best] += d
                if best != home:
                    own[i], moved, changed = best, True, True
        if not changed:
            return names[label]
        left, place = np.unique(own, return_inverse=True)
        label, names = place[label], names[left]
        pairs, at = np.unique(place[x] * len(left) + place[other], return_inverse=True)
        x, other, weight = pairs // len(left), pairs % len(left), np.bincount(at, weight, len(pairs))


def communities(edges: DataFrame, checkpoint=None, most_nodes: int = KERNEL_NODES) -> DataFrame:
    """case_id, node, community (its smallest member)."""
    if checkpoint is not None:
        edges = checkpoint(edges.select("case_id", "u", "v", "weight"))
        small, large = _by_size(edges, most_nodes)
        out = communities(small)
        if not large.take(1):
            return out
        parts, rest = _parts(large, checkpoint, most_nodes)
        weights = large.groupBy("case_id").agg(F.sum(2 * F.col("weight").cast("double")).alias("_total"))
        out = out.unionByName(communities(parts.join(weights, "case_id")))
        return out if rest is None else out.unionByName(by_joins.communities(rest, checkpoint, weights))
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def kernel(table: pa.Table) -> pa.Table:
        nodes, begin, other, row = _directed(table, natural=False)
        weight = table["weight"].to_numpy()[row]
        found = louvain(begin, other, weight, total=table["_total"][0].as_py() if "_total" in table.column_names else None)
        order = pc.array_sort_indices(nodes).to_numpy()  # texts and values may come in another order
        least = np.empty(len(nodes), dtype=np.int64)
        least[found[order[::-1]]] = order[::-1]
        return pa.table({"case_id": _case_of(table, len(nodes)), "node": nodes, "community": nodes.take(pa.array(least[found]))})

    by, more = (["case_id", *(c for c in edges.columns if c == "_bin")], [c for c in edges.columns if c == "_total"])
    rows = edges.select(*by, *more, "u", "v", F.col("weight").cast("double"))
    return _dealt(rows, *by).applyInArrow(kernel, f"case_id {kinds['case_id']}, node {kinds['u']}, community {kinds['u']}")


def far_path(edges: DataFrame, source, target, checkpoint) -> DataFrame:
    """shortest_path for cases of any size: each round extends the best known paths by one edge, until none improves.
    Of equal distances the path that comes first in order wins, as in the kernel."""
    both = ends(edges).select("case_id", "node", "other", "distance", "weight")
    start = both.where(F.col("node") == source).select("case_id", "node").distinct()
    best = start.select("case_id", "node", F.struct(F.lit(0.0).alias("d"), F.array("node").alias("path"), F.lit(1.0).alias("w")).alias("b"))
    best = front = checkpoint(best)
    while True:
        goal = best.where(F.col("node") == target).select("case_id", F.col("b.d").alias("goal"))
        step = both.join(front, ["case_id", "node"]).where(~F.array_contains("b.path", F.col("other")))
        step = step.select("case_id", F.col("other").alias("node"), F.struct(
            (F.col("b.d") + F.col("distance")).alias("d"), F.array_append("b.path", F.col("other")).alias("path"), F.least("b.w", F.col("weight").cast("double")).alias("w")).alias("n"))
        step = step.groupBy("case_id", "node").agg(F.min("n").alias("n")).join(goal, "case_id", "left")
        step = step.where(F.col("goal").isNull() | (F.col("n.d") <= F.col("goal"))).drop("goal")
        merged = best.join(step, ["case_id", "node"], "full_outer")
        better = F.col("n").isNotNull() & (F.col("b").isNull() | (F.col("n") < F.col("b")))
        merged = checkpoint(merged.select("case_id", "node", F.when(better, F.col("n")).otherwise(F.col("b")).alias("b"), better.alias("new")))
        best, front = merged.drop("new"), merged.where("new").drop("new")
        if not front.take(1):
            break
    nodes = both.where(F.col("node").isin(source, target)).select("case_id", "node").distinct().groupBy("case_id").agg(F.count("*").alias("n"))
    end = best.where(F.col("node") == target).select("case_id", "b")
    out = edges.select("case_id").distinct().join(nodes, "case_id", "left").join(end, "case_id", "left")
    missing = F.coalesce("n", F.lit(0)) < (1 if source == target else 2)
    return out.select(
        "case_id", F.col("b").isNotNull().alias("found"), F.array_join(F.transform("b.path", lambda x: x.cast("string")), ">").alias("path"),
        F.round("b.d", 6).alias("distance"), F.when(F.size("b.path") > 1, F.col("b.w")).alias("weakest"),
        F.when(missing, "an end has no relations here").when(F.col("b").isNull(), "no chain of relations joins them").alias("reason"),
    )


def shortest_path(edges: DataFrame, source, target, checkpoint=None, most_nodes: int = KERNEL_NODES) -> DataFrame:
    """Per case: found, path (nodes joined by '>'), distance, weakest (least confidence on it), reason where not found.

    Cases of up to `most_nodes` nodes are solved one at a time; larger ones, given a `checkpoint` function (see lineage),
    by the parts that hold the two ends, and by rounds of joins where these are as large."""
    if checkpoint is not None:
        edges = checkpoint(edges.select("case_id", "u", "v", "distance", "weight"))
        small, large = _by_size(edges, most_nodes)
        out = shortest_path(small, source, target)
        if not large.take(1):
            return out
        home = checkpoint(connected_parts(large, checkpoint))
        here = home.where(F.col("node").isin(source, target)).select("case_id", "component").distinct()
        inside = home.join(here, ["case_id", "component"]).select("case_id", F.col("node").alias("u"))
        held = checkpoint(large.join(inside, ["case_id", "u"]))  # the parts of the two ends alone
        near, far = _by_size(held, most_nodes)
        out = out.unionByName(shortest_path(near, source, target))
        if far.take(1):
            out = out.unionByName(far_path(far, source, target, checkpoint))
        bare = large.select("case_id").distinct().join(held.select("case_id"), "case_id", "left_anti")
        given = {"found": F.lit(False), "reason": F.lit("an end has no relations here")}
        return out.unionByName(bare.select("case_id", *(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in out.schema.fields[1:])))
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    schema = f"case_id {kinds['case_id']}, found boolean, path string, distance double, weakest double, reason string"

    def kernel(table: pa.Table) -> pa.Table:
        nodes, begin, other, row = _directed(table)
        distance, weight = table["distance"].to_numpy()[row], table["weight"].to_numpy()[row]
        at = lambda x: pc.index(nodes, pa.scalar(x, nodes.type)).as_py()
        start, goal = at(source), at(target)
        out = dict(found=False, path=None, distance=None, weakest=None, reason=None)
        if start < 0 or goal < 0:
            out["reason"] = "an end has no relations here"
        else:
            best, done, heap = {start: (0.0, (start,))}, set(), [(0.0, (start,))]
            while heap and goal not in done:
                d, path = heappop(heap)
                x = path[-1]
                if x in done:
                    continue
                done.add(x)
                few, bound = slice(begin[x], begin[x + 1]), best[goal][0] if goal in best else float("inf")
                for y, w in zip(other[few].tolist(), distance[few].tolist(), strict=True):
                    if y not in done and d + w <= bound and (y not in best or (d + w, (*path, y)) < best[y]):
                        best[y] = d + w, (*path, y)
                        heappush(heap, best[y])
            if goal not in done:
                out["reason"] = "no chain of relations joins them"
            else:
                path = best[goal][1]
                links = [weight[begin[x] + np.searchsorted(other[begin[x] : begin[x + 1]], y)] for x, y in zip(path, path[1:], strict=False)]
                names = nodes.take(pa.array(path)).to_pylist()
                out |= dict(found=True, path=">".join(map(str, names)), distance=round(best[goal][0], 6), weakest=min(map(float, links), default=None))
        kind = dict(found=pa.bool_(), path=pa.string(), distance=pa.float64(), weakest=pa.float64(), reason=pa.string())
        return pa.table({"case_id": _case_of(table, 1), **{k: pa.array([v], kind[k]) for k, v in out.items()}})

    rows = edges.select("case_id", "u", "v", "distance", F.col("weight").cast("double"))
    return _dealt(rows, "case_id").applyInArrow(kernel, schema)


def eigenvector(edges: DataFrame, rounds: int = 500, close: float = 1e-6, checkpoint=None, most_nodes: int = KERNEL_NODES) -> DataFrame:
    """case_id, node, score: weighted power iteration per case, the degree centrality where it does not settle in `rounds`."""
    if checkpoint is not None:
        edges = checkpoint(edges.select("case_id", "u", "v", "weight"))
        small, large = _by_size(edges, most_nodes)
        near = eigenvector(small, rounds, close)
        if not large.take(1):
            return near
        parts, rest = _parts(large, checkpoint, most_nodes)
        parts = checkpoint(parts)
        if rest is not None:
            whole = rest.select("case_id").distinct()
            near = near.unionByName(by_joins.eigenvector(large.join(whole, "case_id", "left_semi"), checkpoint, rounds, close))
            parts = parts.join(whole, "case_id", "left_anti")
        return near.unionByName(_eigenvector_of_parts(parts, rounds, close))
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}

    def kernel(table: pa.Table) -> pa.Table:
        nodes, i, j = _numbered(table)
        n, w = len(nodes), table["weight"].to_numpy()
        x, settled = np.full(n, 1 / n), False
        for _ in range(rounds):
            y = x + np.bincount(i, w * x[j], n) + np.bincount(j, w * x[i], n)
            y /= np.linalg.norm(y) or 1
            if settled := np.abs(y - x).sum() < n * close:
                x = y
                break
            x = y
        if not settled:
            x = (np.bincount(i, minlength=n) + np.bincount(j, minlength=n)) / max(1, n - 1)
        return pa.table({"case_id": _case_of(table, n), "node": nodes, "score": np.round(x, 6)})

    rows = edges.select("case_id", "u", "v", F.col("weight").cast("double"))
    return _dealt(rows, "case_id").applyInArrow(kernel, f"case_id {kinds['case_id']}, node {kinds['u']}, score double")


def _eigenvector_of_parts(parts: DataFrame, rounds: int, close: float) -> DataFrame:
    """eigenvector of cases by the bins of their connected parts, which the iteration joins by the case's length alone: the bins'
    lengths of every round give the cases' lengths, these the round in which each case settles, and that the scores. Lengths are
    logarithms; a number a case and round passes through the driver."""
    import numpy as np

    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    case, node = kinds["case_id"], kinds["u"]
    rows = parts.select("case_id", "_bin", "_n", "u", "v", F.col("weight").cast("double").alias("weight"))

    def powers(pdf: pd.DataFrame):
        """The nodes, then of each round from 0 on a vector of length one (in round 0: as it is) and the logarithm of its length."""
        nodes = sorted({*pdf.u, *pdf.v})
        at = {x: i for i, x in enumerate(nodes)}
        i, j, w = pdf.u.map(at).to_numpy(), pdf.v.map(at).to_numpy(), pdf.weight.to_numpy()
        x, size = np.full(len(nodes), 1 / pdf["_n"].iloc[0]), 0.0
        yield nodes, None
        while True:
            yield x, size
            y = x + np.bincount(i, w * x[j], len(nodes)) + np.bincount(j, w * x[i], len(nodes))
            length = float(np.linalg.norm(y))
            x, size = y / length, size + float(np.log(length))

    def lengths(most: int):
        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            steps = powers(pdf)
            next(steps), next(steps)
            return pd.DataFrame({"case_id": pdf.case_id.iloc[0], "k": range(1, most + 1), "size": [next(steps)[1] for _ in range(most)]})

        return kernel

    def changes(of: dict, most: int):
        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            one, steps = pdf.case_id.iloc[0], powers(pdf)
            next(steps)
            was, off = next(steps)[0], []
            for k in range(1, most + 1):
                x, size = next(steps)
                x = x * np.exp(size - of[one, k])
                off.append(float(np.abs(x - was).sum()))
                was = x
            return pd.DataFrame({"case_id": one, "n": int(pdf["_n"].iloc[0]), "k": range(1, most + 1), "off": off})

        return kernel

    def scores(of: dict, settled: dict):
        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            one, steps = pdf.case_id.iloc[0], powers(pdf)
            nodes, _ = next(steps)
            for _ in range(settled[one] + 1):
                x, size = next(steps)
            return pd.DataFrame({"case_id": one, "node": nodes, "score": np.round(x * np.exp(size - of[one, settled[one]]), 6)})

        return kernel

    out, left = None, rows
    for most in sorted({min(64, rounds), rounds}):
        bins = left.groupBy("case_id", "_bin").applyInPandas(lengths(most), f"case_id {case}, k int, size double")
        per = bins.groupBy("case_id", "k").agg(F.max("size").alias("m"), F.collect_list("size").alias("all"))
        total = F.col("m") + 0.5 * F.log(F.aggregate(F.transform("all", lambda s: F.exp(2 * (s - F.col("m")))), F.lit(0.0), lambda a, b: a + b))
        of = {(r.case_id, r.k): r.size for r in per.select("case_id", "k", total.alias("size")).collect()}
        off = left.groupBy("case_id", "_bin").applyInPandas(changes(of, most), f"case_id {case}, n long, k int, off double")
        calm = off.groupBy("case_id", "k").agg((F.sum("off") < F.max("n") * F.lit(close)).alias("calm")).where("calm")
        settled = {r.case_id: r.k for r in calm.groupBy("case_id").agg(F.min("k").alias("k")).collect()}
        done = left.where(F.col("case_id").isin(*settled)) if settled else left.limit(0)
        found = done.groupBy("case_id", "_bin").applyInPandas(scores(of, settled), f"case_id {case}, node {node}, score double")
        out = found if out is None else out.unionByName(found)
        left = left.where(~F.col("case_id").isin(*settled)) if settled else left
        if len(settled) == len({c for c, _ in of}):
            return out
    return out.unionByName(degree_centrality(left).select("case_id", "node", F.col("centrality").alias("score")))


def whole_overview(edges: DataFrame, checkpoint) -> DataFrame:
    """overview with communities and bridge relationships."""
    edges = checkpoint(edges.select("case_id", "u", "v", "weight", "observations"))
    n = communities(edges, checkpoint).groupBy("case_id").agg(F.count_distinct("community").alias("communities"))
    b = bridge_edges(edges, checkpoint).groupBy("case_id").agg(F.count("*").alias("bridges"))
    out = overview(edges).join(n, "case_id", "left").join(b, "case_id", "left")
    return out.withColumn("bridges", F.coalesce("bridges", F.lit(0).cast("long")))


def overview(edges: DataFrame) -> DataFrame:
    """Per case: entities, relationships, observations, and isolated (0: nodes come from edges alone)."""
    nodes = ends(edges).groupBy("case_id").agg(F.count_distinct("node").alias("entities"))
    links = edges.groupBy(F.col("case_id").alias("_c")).agg(F.count("*").alias("relationships"), F.sum("observations").alias("observations"))
    return nodes.join(links, F.col("case_id") == F.col("_c")).select("case_id", "entities", "relationships", "observations", F.lit(0).alias("isolated"))
