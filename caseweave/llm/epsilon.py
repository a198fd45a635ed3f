"""Near-duplicate vectors by an epsilon grid order join.

Cosine similarity of t or more is Euclidean distance of sqrt(2 - 2t) or less between unit vectors: the epsilon of the join.
Distinct vectors are projected on the leading principal directions of all of them, sorted by their cells of a grid of that
width, and cut into sequence intervals. Pairs of intervals are joined recursively: from runs of many intervals down to single
ones as Spark joins of their bounding boxes, and inside a pair of intervals down to pages and leaves, skipping whatever the
boxes or balls prove distant and taking whole what the balls prove near. What is left is compared by matrix products in single
precision, and in double precision where that can't decide. A pair of intervals gives back counts and a spanning forest of its
links, so a dense group costs its size in rows and not its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .codes import usable
from .components import connected_components
from .shared import discard, materialize, table

PAGE, LEAF, FANOUT, TOP = 256, 64, 8, 64
INTERVAL_BYTES = 8 << 20  # of one interval's vectors in single precision: what a task holds
STRIPS = 16  # intervals of a small table
SLACK = 1e-7  # on distances


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; scaled by powers of two first, so that no square leaves the range."""
    x = vectors.astype(float)
    top = np.abs(x).max(axis=1, initial=0)
    x = np.ldexp(x, -np.frexp(np.where(top > 0, top, 1))[1][:, None])
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)[:, None]


def matrix(column, width: int, kind=float) -> np.ndarray:
    """A column of number lists as a matrix, shorter lists filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), kind)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def principal(vectors: DataFrame, width: int, n_dirs: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, leading principal directions as columns) of all vectors' unit forms, by two passes of subspace iteration.

    Any orthonormal directions give right results; these prune most. A pass brings width x directions sums to the driver."""
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(width, min(width, n_dirs + 8))))[0]
    mean = np.zeros(width)
    for last in (False, True):

        def run(batches, q=q):
            y, s, n = np.zeros_like(q), np.zeros(width), 0
            for b in batches:
                x = unit(matrix(b.column(0), width))
                y += x.T @ (x @ q)
                s += x.sum(axis=0)
                n += len(x)
            both = np.c_[y, s]
            i, j = np.indices(both.shape)
            if n:
                cols = [np.r_[i.ravel(), -1], np.r_[j.ravel(), 0], np.r_[both.ravel(), n]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["i", "j", "s"])

        got = vectors.select("v").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
        i, j, s = (got.column(c).to_numpy() for c in ("i", "j", "s"))
        n = s[i == -1][0]
        both = np.zeros((width, q.shape[1] + 1))
        both[i[i >= 0], j[i >= 0]] = s[i >= 0]
        mean = both[:, -1] / n
        y = both[:, :-1] / n - np.outer(mean, mean @ q)
        if last:
            _, turn = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
            q = q @ turn[:, ::-1]
        else:
            q = np.linalg.qr(y + 1e-12 * q)[0]
    return mean, np.ascontiguousarray(q[:, :n_dirs])


def features(x: np.ndarray, mean: np.ndarray, dirs: np.ndarray) -> np.ndarray:
    """Leading coordinates of unit vectors and, last, the length of the rest: no two vectors are nearer than their features."""
    y = x - mean
    p = y @ dirs
    return np.c_[p, np.sqrt(np.maximum(0, (y * y).sum(axis=1) - (p * p).sum(axis=1)))]


def gap2(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Squared distances of boxes a to boxes b."""
    g = np.maximum(lo_a[:, None] - hi_b[None], lo_b[None] - hi_a[:, None])
    return (np.maximum(g, 0) ** 2).sum(axis=2)


def merge(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; lab keeps for each element the smallest member of its class."""
    while True:
        la, lb = lab[a], lab[b]
        m = la != lb
        if not m.any():
            return
        a, b, la, lb = a[m], b[m], la[m], lb[m]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(nxt := lab[lab], lab):
            lab[:] = nxt


class Side:
    """Some vectors in grid order with the boxes and balls of their leaves."""

    def __init__(self, vectors: np.ndarray, copies: np.ndarray, mean: np.ndarray, dirs: np.ndarray):
        self.x, self.copies = unit(vectors), copies
        self.x32 = self.x.astype(np.float32)
        self.cuts = np.arange(0, len(self.x), LEAF)
        self.ends = np.r_[self.cuts[1:], len(self.x)]
        f = features(self.x, mean, dirs)
        self.lo, self.hi = np.minimum.reduceat(f, self.cuts), np.maximum.reduceat(f, self.cuts)
        self.centre = np.add.reduceat(self.x, self.cuts) / (self.ends - self.cuts)[:, None]
        self.leaf = np.repeat(np.arange(len(self.cuts)), self.ends - self.cuts)
        self.radius = np.sqrt(np.maximum.reduceat(((self.x - self.centre[self.leaf]) ** 2).sum(axis=1), self.cuts))
        self.weight = np.add.reduceat(copies, self.cuts)
        cuts = np.arange(0, len(self.cuts), FANOUT)  # nodes over the leaves
        self.node_lo, self.node_hi = np.minimum.reduceat(self.lo, cuts), np.maximum.reduceat(self.hi, cuts)


def leaf_pairs(a: Side, b: Side, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaves of a, leaves of b, whether all their pairs are near) of the leaf pairs that aren't provably distant."""
    limit = (reach + SLACK) ** 2
    i, j = np.nonzero(gap2(a.node_lo, a.node_hi, b.node_lo, b.node_hi) <= limit)
    o = np.arange(FANOUT)
    i, j = (x.ravel() for x in np.broadcast_arrays((i[:, None] * FANOUT + o)[:, :, None], (j[:, None] * FANOUT + o)[:, None, :]))
    there = (i < len(a.cuts)) & (j < len(b.cuts))
    i, j = i[there], j[there]
    g = np.maximum(np.maximum(a.lo[i] - b.hi[j], b.lo[j] - a.hi[i]), 0)
    keep = (g * g).sum(axis=1) <= limit
    i, j = i[keep], j[keep]
    away = np.sqrt(((a.centre[i] - b.centre[j]) ** 2).sum(axis=1))
    slack = a.radius[i] + b.radius[j] + SLACK
    keep = away - slack <= reach
    return i[keep], j[keep], (away + slack <= reach)[keep]


class Tile:
    """The links between one interval, held, and the pages of another, or of the interval itself."""

    def __init__(self, held: Side, places: np.ndarray, t: float, itself: bool):
        self.held, self.places, self.t, self.itself = held, [places], t, itself
        self.reach = math.sqrt(max(0.0, 2 - 2 * t))
        self.links = [np.zeros(len(places), np.int64)]
        self.lab = np.arange(len(places))
        self.compared = 0

    def add(self, page: Side, places: np.ndarray, at: int) -> None:
        """Join a page. `at`: its first row in the held interval if it belongs to it, else ignored."""
        h, mine = self.held, np.zeros(len(places), np.int64)
        first = at if self.itself else len(self.lab)
        if not self.itself:
            self.lab = np.r_[self.lab, first + np.arange(len(places))]
            self.places.append(places)
            self.links.append(mine)
        i, j, near = leaf_pairs(h, page, self.reach)
        theirs = self.links[0]
        for b in np.unique(j):
            rows = slice(page.cuts[b], page.ends[b])
            of = j == b
            whole, some = i[of & near], i[of & ~near]
            if len(whole):
                n = h.weight[whole].sum()
                mine[rows] += n
                inside = np.isin(h.leaf, whole)
                if self.itself:  # a row isn't its own link
                    own = np.arange(first + rows.start, first + rows.stop)
                    mine[rows] -= np.where(inside[own], page.copies[rows], 0)
                else:
                    theirs[inside] += page.weight[b]
                here = np.flatnonzero(inside)
                merge(self.lab, here, np.full(len(here), first + rows.start))
                own = first + np.arange(rows.start, rows.stop)
                merge(self.lab, own, np.full(len(own), here[0]))
            if len(some):
                here = slice(None) if len(some) == len(h.cuts) else np.flatnonzero(np.isin(h.leaf, some))
                index = np.arange(len(h.x)) if isinstance(here, slice) else here
                got = page.x32[rows] @ h.x32[here].T
                self.compared += got.size
                error = (h.x.shape[1] + 16) * 2.0**-23
                r, c = np.nonzero(got >= np.float32(self.t - error))
                if not len(r):
                    continue
                close = np.flatnonzero(np.abs(got[r, c] - self.t) <= 2 * error)
                sure = np.ones(len(r), bool)
                for k in range(0, len(close), 1 << 14):
                    z = close[k : k + (1 << 14)]
                    sure[z] = np.einsum("ij,ij->i", page.x[rows][r[z]], h.x[index[c[z]]]) >= self.t
                r, c = r[sure] + rows.start, index[c[sure]]
                if self.itself:
                    r, c = r[c != first + r], c[c != first + r]
                else:
                    theirs += np.bincount(c, page.copies[r], minlength=len(theirs)).astype(np.int64)
                mine += np.bincount(r, h.copies[c], minlength=len(mine)).astype(np.int64)
                merge(self.lab, first + r, c)
        if self.itself:
            theirs[first : first + len(mine)] += mine

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, links, smallest linked member's place) of the rows with links."""
        n, places = np.concatenate(self.links), np.concatenate(self.places)
        on = np.flatnonzero(n)
        return places[on], n[on], places[self.lab[on]]


def _tiles(mean, dirs, t: float, kind: str):
    def side(pages):
        x = np.concatenate([np.frombuffer(p[2], kind).reshape(-1, len(mean)) for p in pages])
        return Side(x, np.concatenate([np.frombuffer(p[1], "<i8") for p in pages]), mean, dirs), np.concatenate([np.arange(p[0], p[0] + len(p[1]) // 8) for p in pages])

    def close(tile):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in tile.result()], ["place", "n", "root"])

    def finish(tile, pages, itself):
        """The tile of a held interval, once its last page has come."""
        if tile is None:
            held, places = side(pages)
            tile = Tile(held, places, t, itself)
            if itself:
                for p in pages:
                    tile.add(*side([p]), int(p[0] - places[0]))
        return tile

    def run(batches):
        now, tile, pages, itself = None, None, [], False
        for b in batches:
            ids, sides, selves, places = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            for r in range(b.num_rows):
                if ids[r] != now:
                    if now is not None:
                        yield close(finish(tile, pages, itself))
                    now, tile, pages, itself = ids[r], None, [], bool(selves[r])
                page = (int(places[r]), b.column(4)[r].as_py(), b.column(5)[r].as_py())
                if sides[r] == 0:
                    pages.append(page)
                else:
                    tile = finish(tile, pages, False)
                    tile.add(*side([page]), 0)
        if now is not None:
            yield close(finish(tile, pages, itself))

    return run


def _ordered(mean, dirs, reach: float, vectors: DataFrame, n: int) -> DataFrame:
    """part, row (its place in the part), v, least, n: the vectors in grid order, equal cells in the order of a hash."""
    kind = vectors.schema["v"].dataType.simpleString()

    def cells(batches):
        for b in batches:
            f = features(unit(matrix(b.column(0), len(mean))), mean, dirs)[:, :-1]
            grid = np.floor(f / reach if reach else f * 2.0**40).astype(np.int64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(grid) + 1) * grid.shape[1], pa.int32()), pa.array(grid.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), flat], ["v", "least", "n", "cells"])

    def numbered(batches):
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            ends = [pa.array(np.full(b.num_rows, part, np.int64)), pa.array(np.arange(at, at + b.num_rows))]
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*ends, *b.columns], ["part", "row", "v", "least", "n"])

    least = vectors.schema["least"].dataType.simpleString()
    with_cells = vectors.select("v", "least", "n").mapInArrow(cells, f"v {kind}, least {least}, n long, cells array<long>")
    with_cells = materialize(with_cells.withColumn("h", F.xxhash64("v")), "cells")  # read twice: for the ranges, then for the sort
    sorted_ = with_cells.repartitionByRange(n, "cells", "h").sortWithinPartitions("cells", "h").select("v", "least", "n")
    out = materialize(sorted_.mapInArrow(numbered, f"part long, row long, v {kind}, least {least}, n long"), "ordered")
    discard(with_cells)
    return out


def _pages(ordered: DataFrame, mean, dirs, kind: str) -> DataFrame:
    """interval, page, place (of the first row), copies, vectors and the page's box of rows with `interval` and `place`."""
    grouped = ordered.groupBy("interval", F.expr(f"place div {PAGE}").alias("page")).agg(F.sort_array(F.collect_list(F.struct("place", "n", "v"))).alias("s"))
    rows = grouped.select("interval", "page", F.col("s")[0]["place"].alias("place"), F.col("s.n").alias("n"), F.flatten(F.transform("s", lambda x: _filled(x["v"], len(mean)))).alias("v"))

    def run(batches):
        for b in batches:
            out = [[] for _ in range(4)]
            for i in range(b.num_rows):
                x = b.column(4).slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, len(mean))
                f = features(unit(x), mean, dirs)
                for o, v in zip(out, (b.column(3).slice(i, 1).flatten().to_numpy().astype("<i8").tobytes(), x.tobytes(), f.min(axis=0), f.max(axis=0)), strict=True):
                    o.append(v)
            arrays = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.float64())), pa.array(out[3], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *arrays], ["interval", "page", "place", "copies", "vectors", "lo", "hi"])

    schema = "interval long, page long, place long, copies binary, vectors binary, lo array<double>, hi array<double>"
    return materialize(rows.mapInArrow(run, schema), "pages")


def _filled(v, width: int):
    """Shorter vectors count as filled with zeros."""
    zero = F.lit(0).cast("double")
    return F.when(F.size(v) == width, v).otherwise(F.concat(v, F.transform(F.array_repeat(zero, F.greatest(F.lit(0), F.lit(width) - F.size(v))), lambda x: x.cast("float"))))


def _boxes(boxes: DataFrame, by) -> DataFrame:
    """The boxes of runs of rows (node, lo, hi)."""
    parts = boxes.select(by.alias("node"), F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "x"))
    parts = parts.groupBy("node", "d").agg(F.min("x.lo").alias("lo"), F.max("x.hi").alias("hi"))
    got = parts.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("d", "lo", "hi"))).alias("s"))
    return got.select("node", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))


def interval_pairs(pages: DataFrame, n_intervals: int, reach: float) -> DataFrame:
    """Pairs (i <= j) of intervals whose boxes come within reach, found from runs of FANOUT^k intervals downwards."""
    levels = [materialize(_boxes(pages, F.col("interval")), "boxes")]
    n = n_intervals
    while n > TOP:
        levels.append(materialize(_boxes(levels[-1], F.expr(f"node div {FANOUT}")), "boxes"))
        n = -(-n // FANOUT)
    spark = pages.sparkSession
    pairs = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.col("id"), F.lit(n - 1).cast("long"))).alias("j"))  # of TOP nodes at most
    limit = (reach + SLACK) ** 2
    for boxes in reversed(levels):
        if boxes is not levels[-1]:
            child = lambda c: F.explode(F.sequence(F.col(c) * FANOUT, F.col(c) * FANOUT + FANOUT - 1))
            pairs = pairs.select(child("i").alias("i"), "j").select("i", child("j").alias("j")).where("i <= j")
        a = boxes.select(F.col("node").alias("i"), F.col("lo").alias("la"), F.col("hi").alias("ha"))
        b = boxes.select(F.col("node").alias("j"), F.col("lo").alias("lb"), F.col("hi").alias("hb"))
        gap = F.zip_with(
            F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))
        )
        apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
        pairs = materialize(pairs.join(a, "i").join(b, "j").where(apart <= limit).select("i", "j"), "pairs")
    return pairs


def link_counts(vectors: DataFrame, t: float, n_dirs: int = 16, interval_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(ordered: place, v, least, n; links: place, links, root) of distinct usable vectors v with their copies n and least ids."""
    spark = vectors.sparkSession
    width, count = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reach = math.sqrt(max(0.0, 2 - 2 * t))
    mean, dirs = principal(vectors, width, min(n_dirs, width))
    ordered = _ordered(mean, dirs, reach, vectors, parts)
    begins, at = [], 0  # one number for each part
    for part, n in sorted(map(tuple, ordered.groupBy("part").count().collect())):
        begins.append((part, at))
        at += n
    rows = interval_rows or min(max(PAGE, INTERVAL_BYTES // (4 * width) // PAGE * PAGE), max(PAGE, -(-count // STRIPS // PAGE) * PAGE))
    placed = ordered.join(F.broadcast(spark.createDataFrame(begins, "part long, begin long")), "part")
    place = F.col("begin") + F.col("row")
    placed = placed.select(place.alias("place"), F.floor(place / rows).alias("interval"), "v", "least", "n")
    kind = "<f4" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "<f8"
    pages = _pages(placed, mean, dirs, kind)
    pairs = interval_pairs(pages, -(-count // rows), reach)
    tile = F.col("i") * (1 << 31) + F.col("j")
    half = lambda side, at: pairs.select(tile.alias("tile"), F.lit(side).alias("side"), (F.col("i") == F.col("j")).alias("itself"), F.col(at).alias("interval"))
    sides = half(0, "i").unionByName(half(1, "j").where("NOT itself"))
    moved = sides.join(pages.drop("lo", "hi"), "interval").repartition(parts, "tile").sortWithinPartitions("tile", "side", "place")
    out = moved.select("tile", "side", "itself", "place", "copies", "vectors").mapInArrow(_tiles(mean, dirs, t, kind), "place long, n long, root long")
    return placed, materialize(out, "links")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", t: float = 0.9, n_dirs: int = 16, interval_rows: int | None = None
) -> DataFrame:
    """One row for each input row: id, n_links (other rows at cosine t or more), component_id (smallest id of the class), kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept. Shorter vectors
    count as filled with zeros. Equal vectors are compared once and counted as often as they come. Repeated rows are rows of
    their own and link with each other. A null id is never a smallest id unless its class has no other, then component_id is
    null; kept is then false, as it is for a null id. Other columns are ignored, whatever their names; no rows give none.
    """
    if not 0 < t <= 1:
        raise ValueError("a cosine above 0 and up to 1")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    if rows.schema["v"].dataType.simpleString() != "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    good = F.coalesce(usable(F.col("v")) & F.exists("v", lambda x: x != 0), F.lit(False))
    distinct = materialize(rows.where(good).groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = alone
    if distinct.take(1):
        placed, links = link_counts(distinct, t, n_dirs, interval_rows)
        roots = materialize(connected_components(links.select(F.col("place").alias("u"), F.col("root").alias("v"))), "roots")
        linked = links.groupBy("place").agg(F.sum("n").alias("links"))
        named = placed.join(linked, "place", "left").join(roots.withColumnRenamed("node", "place"), "place", "left")
        named = named.select("v", "least", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "place").alias("root"))
        named = materialize(named, "named")
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        named = named.join(least, "root")
        once = named.where("n = 1").select(F.col("least").alias("id"), "n_links", "component_id")
        several = named.where("n > 1").select(F.col("v").alias("w"), "n_links", "component_id")
        again = rows.where(good).join(several, F.col("v") == F.col("w")).select("id", "n_links", "component_id")
        out = alone.unionByName(once).unionByName(again)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: All pairs and a recursive walk: for small tables.
SQL = """WITH RECURSIVE good AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.9),
walk(r, s) AS (SELECT r, r FROM good UNION SELECT w.r, l.b FROM walk w JOIN link l ON l.a = w.s),
found AS (
  SELECT g.r, g.vec_id, (SELECT count(*) FROM link WHERE a = g.r) AS n_links,
    (SELECT min(o.vec_id) FROM walk w JOIN good o ON o.r = w.s WHERE w.r = g.r) AS component_id FROM good g)
SELECT vec_id, n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM found
UNION ALL
SELECT vec_id, 0, vec_id, vec_id IS NOT NULL FROM embeddings
WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0
  OR len(list_filter(embedding, lambda x: x <> 0)) = 0"""
