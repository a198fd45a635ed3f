import math
import random

import numpy as np
import pytest

from caseweave.llm import epsilon


def slow(rows, t=0.9):
    """rows: (id, vector); the definition."""
    width = max([len(v) for _, v in rows if v] or [0])
    ok = [v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    x = np.zeros((len(rows), width))
    for i, (_, v) in enumerate(rows):
        if ok[i]:
            w = np.array(v, float)
            w = w / np.abs(w).max()
            x[i, : len(v)] = w / np.linalg.norm(w)
    near = (x @ x.T >= t) & np.outer(ok, ok)
    np.fill_diagonal(near, False)
    lab = list(range(len(rows)))
    for i in range(len(rows)):
        todo = [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if lab[j] > lab[i]:
                    lab[j] = lab[i]
                    todo.append(j)
    out = []
    for i, (a, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if lab[j] == lab[i] and rows[j][0] is not None]
        c = min(ids, default=None) if ok[i] else a
        out.append((a, int(near[i].sum()), c, a is not None and a == c))
    return sorted(map(repr, out))


def frame(spark, rows, kind="float"):
    wide = [(*r, i, "x", 1.0, [0.1], 2) for i, r in enumerate(rows)]
    return spark.createDataFrame(wide, f"vec_id long, embedding array<{kind}>, place long, id string, v double, n array<double>, least int")


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def planted(rng, n, width):
    """Lone vectors, chains, tight and loose groups, scaled copies and equal rows."""
    v = [rng.normal(size=width) for _ in range(n // 3)]
    for size, noise in ((n // 4, 0.02), (n // 6, 0.35 / math.sqrt(width)), (n // 6, 0.5 / math.sqrt(width))):
        c = rng.normal(size=width)
        c /= np.linalg.norm(c)
        v += [(c + noise * rng.normal(size=width)) * rng.uniform(0.1, 9) for _ in range(size)]
    at = rng.normal(size=width)
    for _ in range(20):  # a chain
        v.append(at / np.linalg.norm(at))
        at = at / np.linalg.norm(at) + 0.4 * rng.normal(size=width) / math.sqrt(width)
    v += [3 * v[0], v[1], v[1], v[-1]]
    return [[float(np.float32(z)) for z in x] for x in v]


@pytest.mark.parametrize("width, interval_rows", [(8, 256), (64, None), (3, 256)])
def test_against_all_pairs(spark, width, interval_rows):
    rng = np.random.default_rng(width)
    rows = [(int(i), v) for i, v in enumerate(planted(rng, 900, width))]
    random.Random(1).shuffle(rows)
    rows += [(rows[0][0], rows[0][1]), (None, rows[3][1]), (None, [1e-3] * (width - 1) + [99.0]), (5000, None), (5001, []), (5002, [0.0] * width), (5003, [math.nan] * width)]
    rows += [(5004, [math.inf] + [1.0] * (width - 1)), (5005, [None] + [1.0] * (width - 1)), (5006, [1.0]), (5007, [2.0] + [0.0] * (width - 1))]
    assert got(epsilon.near_vectors(frame(spark, rows).repartition(3), interval_rows=interval_rows)) == slow(rows)


def test_doubles_of_any_size_and_other_thresholds(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6))
    rows = [(i, [float(z) for z in x * 10.0 ** rng.integers(-200, 200)]) for i, x in enumerate(np.r_[base, base[:30] + 0.01 * rng.normal(size=(30, 6))])]
    for t in (0.5, 0.9, 0.9999, 1.0):
        want = slow(rows, t)
        found = got(epsilon.near_vectors(frame(spark, rows, "double"), t=t))
        assert found == want or t == 1.0
    assert epsilon.near_vectors(frame(spark, rows, "double").limit(0)).count() == 0
    with pytest.raises(ValueError):
        epsilon.near_vectors(frame(spark, rows, "double"), t=0)


def test_descent_from_runs_of_intervals(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, v) for i, v in enumerate(planted(rng, 600, 4))]
    for name, n in (("PAGE", 8), ("LEAF", 4), ("FANOUT", 3), ("TOP", 2)):
        monkeypatch.setattr(epsilon, name, n)
    assert got(epsilon.near_vectors(frame(spark, rows), interval_rows=16)) == slow(rows)


def test_boxes_and_balls_spare_comparisons():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32)) * np.r_[np.full(6, 4.0), np.full(26, 0.3)]
    x = np.repeat(centres, 100, axis=0) + 0.01 * rng.normal(size=(4000, 32))
    dirs = np.eye(32)[:, :6]
    f = epsilon.features(epsilon.unit(x), np.zeros(32), dirs)
    x = x[np.lexsort(np.floor(f[:, :6] / 0.447).T[::-1])]
    ones = np.ones(4000, np.int64)
    side = epsilon.Side(x, ones, np.zeros(32), dirs)
    tile = epsilon.Tile(side, np.arange(4000), 0.9, True)
    for k in range(0, 4000, 256):
        tile.add(epsilon.Side(x[k : k + 256], ones[k : k + 256], np.zeros(32), dirs), np.arange(k, min(4000, k + 256)), k)
    u = epsilon.unit(x)
    assert (tile.links[0] == (u @ u.T >= 0.9).sum(axis=1) - 1).all()
    assert tile.compared < 0.3 * 4000 * 4000
    here = epsilon.features(u[:50], np.zeros(32), dirs)
    d = ((u[:50, None] - u[None, :50]) ** 2).sum(axis=2)
    assert (((here[:, None] - here[None]) ** 2).sum(axis=2) <= d + 1e-9).all()


def test_query_is_its_sql(same_as_sql):
    same_as_sql(epsilon.op12_embedding_near_dedup, epsilon.SQL)
