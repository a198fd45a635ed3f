import hashlib
import math
import random

import numpy as np
import pytest

from caseweave.llm import codes


def slow(rows, parts=8, k=16, rounds=6, scale=4096):
    """rows: (id, vector, label); the definition, with Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return []
    length = max(parts, -(-max(len(r[1]) for r in kept) // parts) * parts)
    quant = lambda v: [math.floor(scale * x) for x in v] + [0] * (length - len(v))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(scale * x) for x in r[1]]))
    w = length // parts
    cut = [[tuple(quant(r[1])[j * w : (j + 1) * w]) for j in range(parts)] for r in kept]
    books = [[cut[i][j] for i in range(min(k, len(kept)))] for j in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, book: min((dist(p, e), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            of = [best(c[j], books[j])[1] for c in cut]
            for e in range(len(books[j])):
                mine = [c[j] for c, o in zip(cut, of) if o == e]
                if mine:
                    books[j][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for r, c in zip(kept, cut):
        got = [best(c[j], books[j]) for j in range(parts)]
        out.append([r[0], "".join(f"{i:02x}" for _, i in got), sum(d for d, _ in got), r[2]])
    for r in out:
        r.append(sum(x[2] for x in out if x[3] == r[3]))
    return sorted(repr((r[0], r[1], r[2], r[4], sha)) for r in out)


def table_of(spark, rows, kind="float"):
    wide = [(*r, i, "x", b"q", 1.0, 2) for i, r in enumerate(rows)]
    return spark.createDataFrame(wide, f"vec_id long, embedding array<{kind}>, label int, row int, id string, q binary, far double, c0 int")


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def odd_rows(rng, n, dim):
    rows = [(rng.randrange(1000), [rng.gauss(0, 0.3) for _ in range(dim)], rng.choice([0, 1, None])) for _ in range(n)]
    rows += [rows[0], rows[0], (7, rows[1][1], 5), (None, rows[2][1], None), (8, None, 1), (9, [1.0, None], 1), (10, [math.nan] * dim, 1)]
    return rows + [(11, [math.inf] * dim, None), (12, [], 2), (13, [0.5], 2), (14, [0.0] * dim, 0), (15, [-0.25] * dim, 0)]


@pytest.mark.parametrize("dim, n", [(16, 60), (20, 5), (64, 30)])
def test_against_the_definition(spark, dim, n):
    rng = random.Random(dim)
    rows = [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for a, v, c in odd_rows(rng, n, dim)]
    assert got(codes.vector_codes(table_of(spark, rows).repartition(5))) == slow(rows)


def test_ties_repeats_and_few_rows(spark):
    rows = [(i, [float(i % 2)] * 8, None) for i in range(40)]
    assert got(codes.vector_codes(table_of(spark, rows, "double"))) == slow(rows)
    assert got(codes.vector_codes(table_of(spark, rows[:1], "double"))) == slow(rows[:1])
    assert got(codes.vector_codes(table_of(spark, rows, "double"), parts=2, entries=3, pivots=9, rounds=0)) == slow(rows, 2, 3, 0)


def test_nothing_usable(spark):
    assert codes.vector_codes(table_of(spark, [(1, None, 1), (2, [None], 2)])).count() == 0
    assert codes.vector_codes(table_of(spark, [(1, None, 1)]).limit(0)).count() == 0
    with pytest.raises(Exception, match="2\\^28"):
        codes.vector_codes(table_of(spark, [(1, [1e9], 1)]))


def test_pivots_prune_and_never_change_a_choice():
    rng = np.random.default_rng(3)
    entries = rng.integers(-2000, 2000, (16, 8))
    x = entries[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))
    x[:200] = entries[rng.integers(0, 16, 200)]  # zero distances
    pivots = codes.spread(entries[None], 4)[0]
    far = codes._distance(x, entries[pivots]).astype(np.float32).astype(float)
    moved = entries + rng.integers(-30, 30, entries.shape)
    moved[5] = moved[2]  # a tie
    at, error, tried = codes.nearest(x, far, moved, entries[pivots])
    d = ((x[:, None] - moved[None]) ** 2).sum(axis=2)
    assert (at == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
    assert tried < 0.5 * x.shape[0] * len(entries)


def test_query_is_its_sql(same_as_sql):
    same_as_sql(codes.op13_vector_codes, codes.SQL)
