"""Product codes of vectors in exact integers; the nearest entries are found by LAESA pivots.

Components become integers, vectors are cut into equal parts, and each part position has a small codebook that a few rounds
of means refine. A few entries of the first codebook are the part's pivots: the distance of every part to its pivots is
computed once and kept beside the part. In each round the distances of the present entries to the pivots give, by the
triangle inequality, a lower bound of every distance; entries are tried in the order of their bounds, and a part is done
as soon as the next bound exceeds the best exact distance. Bounds are floats with a margin, distances are exact integers,
so pruning never changes a result. A round reads the parts where they lie and moves sums alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize, table

STEP = 1 << 16  # numbers of a block of rows: bounds what a task holds besides its batch
MARGIN = 1e-5  # of a pivot distance, kept as float32, and of a bound
HIGHEST = 1 << 28  # with larger components a squared distance may leave 64 bits


@dataclass
class Codebooks:
    """entries[part][entry] are the integer components; `pivots` index the first entries, `first` are those entries."""

    entries: np.ndarray
    first: np.ndarray
    pivots: np.ndarray


def usable(vector):
    """Whether a vector is there and holds neither null nor non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of x to rows of y, from exact squares."""
    d = x[:, None, :].astype(np.int64) - y[None, :, :]
    return np.sqrt((d * d).sum(axis=2).astype(float))


def spread(entries: np.ndarray, n: int) -> np.ndarray:
    """Of each part's entries, n that lie far apart: the first, then always the one farthest from those taken."""
    out = []
    for part in entries:
        took, far = [0], _distance(part, part[:1])[:, 0]
        while len(took) < min(n, len(part)):
            took.append(int(far.argmax()))
            far = np.minimum(far, _distance(part, part[took[-1] :][:1])[:, 0])
        out.append(took)
    return np.array(out, int)


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, ties to the lower; exact squared distance; exact evaluations) for parts x of one position."""
    n, k = len(x), len(entries)
    of_entry = _distance(entries, pivots)
    low = np.zeros((n, k))
    for p in range(len(pivots)):
        np.maximum(low, np.abs(to_pivots[:, p, None] - of_entry[None, :, p]) - MARGIN * (to_pivots[:, p, None] + 1), out=low)
    low = low * low * (1 - MARGIN)
    order = np.argsort(low, axis=1, kind="stable")
    best, at, tried = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), 0
    open_ = np.arange(n)
    for r in range(k):
        e = order[open_, r]
        go = low[open_, e] <= best[open_]  # bounds ascend: who stops here is done
        open_, e = open_[go], e[go]
        if not len(open_):
            break
        d = x[open_].astype(np.int64) - entries[e]
        d = (d * d).sum(axis=1)
        tried += len(d)
        closer = (d < best[open_]) | ((d == best[open_]) & (e < at[open_]))
        best[open_[closer]], at[open_[closer]] = d[closer], e[closer]
    return at, best, tried


def _numbers(column, kind: str, width: int) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    flat = column.cast(pa.large_binary()) if isinstance(column, pa.Array) else column.combine_chunks().cast(pa.large_binary())
    if not len(flat):
        return np.zeros((0, width), kind)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2], kind, (offsets[-1] - offsets[0]) // np.dtype(kind).itemsize, offsets[0]).reshape(-1, width)


def _quantise(parts: int, length: int, first: np.ndarray, pivots: np.ndarray, scale: float):
    width = length // parts

    def run(batches):
        for b in batches:
            vectors = b.column(1)
            n, flat = len(vectors), vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
            q = np.zeros((n, length), np.int64)
            sizes = np.diff(vectors.offsets.to_numpy())
            row = np.repeat(np.arange(n), sizes)
            q[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(flat * scale)
            if np.abs(q).max(initial=0) > HIGHEST:
                raise ValueError("components beyond 2^28 after scaling don't fit exact 64-bit distances")
            far, cube = [], q.reshape(n, parts, width)
            step = max(1, STEP // max(1, length))
            for i in range(0, n, step):
                far.append(np.stack([_distance(cube[i : i + step, j], first[j][pivots[j]]) for j in range(parts)], axis=1))
            far = np.concatenate(far).astype(np.float32) if far else np.zeros((0, 0, 0), np.float32)
            rows = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), rows(q.astype(np.int32)), rows(far.reshape(n, -1))], ["row", "q", "far"])

    return run


def _each_block(batch, books: Codebooks):
    """Blocks of a batch's rows: (from, to, parts, codes, squared errors)."""
    parts, _, width = books.entries.shape
    n_pivots = books.pivots.shape[1]
    q = _numbers(batch.column(1), "<i4", parts * width).reshape(-1, parts, width)
    far = _numbers(batch.column(2), "<f4", parts * n_pivots).reshape(-1, parts, n_pivots)
    step = max(1, 4 * STEP // max(1, books.entries.shape[1], width))
    for i in range(0, len(q), step):
        cube, code, error = q[i : i + step], [], []
        for j in range(parts):
            c, e, _ = nearest(cube[:, j], far[i : i + step, j].astype(float), books.entries[j], books.first[j][books.pivots[j]])
            code.append(c)
            error.append(e)
        yield i, min(len(q), i + step), cube, np.stack(code, axis=1), np.stack(error, axis=1)


def _sums(books: Codebooks):
    def run(batches):
        parts, k, width = books.entries.shape
        total, count = np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            for _, _, cube, code, _ in _each_block(b, books):
                for j in range(parts):
                    for e in np.unique(code[:, j]):
                        mine = code[:, j] == e
                        count[j, e] += mine.sum()
                        total[j, e] += cube[mine, j].sum(axis=0, dtype=np.int64)
        j, e = np.nonzero(count)
        at = np.repeat(np.arange(len(j)), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (j[at], e[at], np.tile(np.arange(width), len(j)), total[j, e].ravel(), count[j, e][at])], ["part", "entry", "place", "s", "n"]
        )

    return run


def fit(rows: DataFrame, books: Codebooks, rounds: int) -> Codebooks:
    """Refine the codebooks over all quantised rows; each round brings one sum for each entry and component to the driver."""
    for _ in range(rounds):
        moved = rows.select("row", "q", "far").mapInArrow(_sums(books), "part long, entry long, place long, s long, n long")
        found = moved.groupBy("part", "entry", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
        new = books.entries.copy()
        for r in found:
            new[r.part, r.entry, r.place] = int(r.s) // r.n
        if np.array_equal(new, books.entries):
            break  # further rounds would change nothing
        books = Codebooks(new, books.first, books.pivots)
    return books


def quantised(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = 8, entries: int = 16,
    pivots: int = 4, scale: float = 4096.0,
) -> tuple[DataFrame, Codebooks] | None:
    """(usable rows as a written table: row {id, kept columns as c0, c1, ...}, q, far; the first codebooks), or None without rows."""
    cols = [F.col(f"`{id_col}`").alias("id"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep))]
    good = vectors.select(F.struct(*cols).alias("row"), F.col(f"`{vector_col}`").alias("v")).where(usable(F.col("v")))
    longest = good.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    length = max(parts, -(-longest // parts) * parts)
    start = good.orderBy(F.col("row.id").asc_nulls_last(), F.transform("v", lambda x: F.floor(x * F.lit(scale)))).limit(entries).select("v").collect()
    first = np.zeros((len(start), length), np.int64)
    for i, r in enumerate(start):
        first[i, : len(r.v)] = np.floor(np.array(r.v, float) * scale)
    first = np.ascontiguousarray(first.reshape(len(start), parts, -1).transpose(1, 0, 2))
    at = spread(first, pivots)
    kinds = good.schema["row"].dataType.simpleString()
    rows = good.mapInArrow(_quantise(parts, length, first, at, scale), f"row {kinds}, q binary, far binary")
    return materialize(rows, "quantised"), Codebooks(first, first, at)


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """row, code (two hex digits a part), error (squared distances summed over parts) of quantised rows."""

    def run(batches):
        for b in batches:
            code, error = [], []
            for _, _, _, c, e in _each_block(b, books):
                code += [r.tobytes().hex() if r.dtype == np.uint8 else "".join(f"{v:02x}" for v in r) for r in (c.astype(np.uint8) if c.max(initial=0) < 256 else c)]
                error.append(e.sum(axis=1))
            errors = np.concatenate(error) if error else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code, pa.string()), pa.array(errors)], ["row", "code", "error"])

    return rows.select("row", "q", "far").mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, code string, error long")


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label", parts: int = 8, entries: int = 16,
    pivots: int = 4, rounds: int = 6, scale: float = 4096.0,
) -> DataFrame:
    """One row for each usable vector: id, code, error, group_error (error summed over equal values of group_col, nulls
    together), codebooks_sha256.

    Vectors that are null or hold null or non-finite components are dropped. The first entries are those of the vectors with
    the smallest ids, null last, equal ids in the order of their components; with fewer vectors than entries a codebook has
    fewer. Shorter vectors, empty ones too, count as filled with zeros to the longest length, and that to a multiple of
    `parts`. Repeated rows give repeated rows. Components beyond 2^28 after scaling are an error. Other columns are ignored,
    whatever their names; no usable rows give none.
    """
    found = quantised(vectors, id_col, vector_col, (group_col,), parts, entries, pivots, scale)
    kind, group = vectors.schema[id_col].dataType.simpleString(), vectors.schema[group_col].dataType.simpleString()
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"id {kind}, code string, error long, group_error long, codebooks_sha256 string")
    rows, books = found
    books = fit(rows, books, rounds)
    digest = hashlib.sha256(",".join(map(str, books.entries.ravel().tolist())).encode()).hexdigest()
    coded = materialize(encode(rows, books).select("row.id", F.col("row.c0").cast(group).alias("g"), "code", "error"), "codes")
    discard(rows)
    of = coded.groupBy(F.col("g").alias("_g")).agg(F.sum("error").alias("group_error"))
    return coded.join(of, F.col("g").eqNullSafe(F.col("_g"))).select("id", "code", "error", "group_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "code", "error", F.col("group_error").alias("label_error"), "codebooks_sha256")


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = []
    for r in range(rounds + 1):
        assign = f"""a{r} AS MATERIALIZED (
  SELECT vec_id, part, min(struct_pack(d := d, e := e)) AS m FROM (
    SELECT q.vec_id, q.part, c.e, sum((q.v - c.v) * (q.v - c.v))::BIGINT AS d
    FROM q JOIN c{r} c ON c.part = q.part AND c.pos = q.pos GROUP BY ALL) GROUP BY ALL)"""
        steps.append(assign)
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.e, c.pos, coalesce(n.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT q.part, a.m.e AS e, q.pos, floor(sum(q.v)::DOUBLE / count(*))::BIGINT AS v
    FROM q JOIN a{r} a ON a.vec_id = q.vec_id AND a.part = q.part GROUP BY ALL) n
  ON n.part = c.part AND n.e = c.e AND n.pos = c.pos)""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS pos, floor(4096 * embedding[i]::DOUBLE)::BIGINT AS v
  FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (
  SELECT q.part, s.e, q.pos, q.v FROM q JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})) s USING (vec_id)),
{", ".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT k.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, e, pos)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept k USING (vec_id)"""


SQL = _sql()
