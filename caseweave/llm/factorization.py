"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), linear in the number of
features of a text. It is fitted with Adam on a bounded number of labelled rows and scores whole texts in
Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import materialize, table

BITS, RANK = 15, 8
_CLASSES = {
    "symbol": b"#*$%&|<>",
    "digit": b"0123456789",
    "upper": bytes(range(65, 91)),
    "stop": b".!?",
    "shout": b"!",
    "comma": b",;:",
    "pipe": b"|",
    "line": b"\n",
}
STATS = len(_CLASSES) + 8


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # words, then statistics
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def features(column: pa.Array, chars: np.ndarray):
    """For each slice of rows: (first row, end, row of each distinct word, its bucket, its value, statistics)."""
    data, offs = tokens.texts(column)
    for lo, hi in tokens.slices(offs):
        o = offs[lo : hi + 1]
        raw = data[o[0] : o[-1]]
        o = o - o[0]
        h, s, e, r = tokens.words(tokens.LOWER[raw], o, tokens.PLAIN)
        n, size = np.diff(r), np.diff(o)
        row = np.repeat(np.arange(hi - lo), n)
        key, tf = np.unique((row.astype(np.int64) << BITS) | (h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        of, bucket = key >> BITS, key & ((1 << BITS) - 1)
        norm = np.sqrt(np.bincount(of, tf.astype(float) ** 2, hi - lo))
        stats = np.zeros((hi - lo, STATS), np.float32)
        many, long_ = np.maximum(n, 1), np.maximum(size, 1)
        for i, chars_of in enumerate(_CLASSES.values()):
            hit = np.zeros(256, np.int64)
            hit[list(chars_of)] = 1
            total = np.r_[0, np.cumsum(hit[raw])]
            stats[:, i] = (total[o[1:]] - total[o[:-1]]) / (many if i != 1 else long_)
        same = np.r_[False, h[1:] == h[:-1]] & np.r_[False, row[1:] == row[:-1]] if len(h) else np.zeros(0, bool)
        count = lambda x: np.bincount(row, x, hi - lo)
        k = len(_CLASSES)
        stats[:, k] = np.log1p(n)
        stats[:, k + 1] = count((e - s).astype(float)) / many
        stats[:, k + 2] = count(same.astype(float)) / many
        stats[:, k + 3] = np.bincount(of, minlength=hi - lo) / np.maximum(n, 1) ** 0.8
        stats[:, k + 4] = np.sqrt(np.maximum(0, count(((e - s) ** 2).astype(float)) / many - stats[:, k + 1] ** 2))
        stats[:, k + 5] = np.log1p(chars[lo:hi])
        stats[:, k + 6] = n == 0
        stats[:, k + 7] = np.bincount(of, tf > 3, hi - lo) / many
        yield lo, hi, of, bucket, (tf / norm[of]).astype(np.float32), stats


def _rows(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(np.array(column.to_pandas(), dtype=float)).clip(0)


def _raw(m: Machine, rows: int, of, bucket, x, z):
    """Scores before the sigmoid, and the factor sums that the gradient needs."""
    k = 1 << BITS
    v = m.factors[bucket] * x[:, None]
    cols = [np.bincount(of, v[:, f], rows) for f in range(RANK)]
    sums = np.stack(cols, axis=1) + z @ m.factors[k:]
    squares = np.bincount(of, (v * v).sum(axis=1), rows) + (z * z) @ (m.factors[k:] ** 2).sum(axis=1)
    line = np.bincount(of, m.linear[bucket] * x, rows) + z @ m.linear[k:]
    return m.bias + line + 0.5 * ((sums**2).sum(axis=1) - squares), sums


def _scaled(m: Machine, stats: np.ndarray) -> np.ndarray:
    return ((stats - m.mean) / m.scale).clip(-4, 4)


def fit(labels: np.ndarray, of, bucket, x, stats, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Fit on rows with labels 0 and 1; both classes weigh the same. Rows of `of` must be sorted."""
    n, k = len(labels), 1 << BITS
    rng = np.random.default_rng(seed)
    mean = stats.mean(axis=0) if n else np.zeros(STATS)
    scale = (stats.std(axis=0) if n else np.zeros(STATS)) + 1e-3
    m = Machine(0.0, np.zeros(k + STATS), rng.normal(0, 0.02, (k + STATS, RANK)), mean, scale)
    if n == 0 or labels.min() == labels.max():
        m.factors[:] = 0
        m.bias = 0.0 if n == 0 else (4.0 if labels[0] else -4.0)
        return m
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    z, bounds = _scaled(m, stats), np.searchsorted(of, np.arange(n + 1))
    params = [np.zeros(1), m.linear, m.factors]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            idx = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in pick])
            row = np.repeat(np.arange(len(pick)), bounds[pick + 1] - bounds[pick])
            b, xv, zb = bucket[idx], x[idx].astype(float), z[pick]
            m.bias = float(params[0][0])
            raw, sums = _raw(m, len(pick), row, b, xv, zb)
            g = weight[pick] * (1 / (1 + np.exp(-raw.clip(-30, 30))) - labels[pick]) / len(pick)
            grad = [np.array([g.sum()]), np.zeros(k + STATS), np.zeros((k + STATS, RANK))]
            np.add.at(grad[1], b, g[row] * xv)
            grad[1][k:] = g @ zb
            np.add.at(grad[2], b, (g[row] * xv)[:, None] * (sums[row] - m.factors[b] * xv[:, None]))
            grad[2][k:] = (g[:, None] * zb).T @ sums - (g @ (zb * zb))[:, None] * m.factors[k:]
            step += 1
            touched = np.r_[np.unique(b), np.arange(k, k + STATS)]
            for p, gr, (m1, m2) in zip(params, grad, moments, strict=True):
                rows = slice(None) if p.ndim == 1 and len(p) == 1 else touched
                gr = gr[rows] + decay * p[rows]
                m1[rows] = 0.9 * m1[rows] + 0.1 * gr
                m2[rows] = 0.999 * m2[rows] + 0.001 * gr * gr
                p[rows] -= rate * (m1[rows] / (1 - 0.9**step)) / (np.sqrt(m2[rows] / (1 - 0.999**step)) + 1e-8)
    m.bias = float(params[0][0])
    return m


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars",
    label_col: str = "quality", most_rows: int = 6_000,
) -> Machine:
    """Fit on labelled documents: `most_rows` of them at most, in the order of hashes of their ids, texts and labels.

    Rows with a null id or label are left out; equal rows (of one id, text and label) count once, however many come. Documents
    are joined to `most_rows` rows of `labels` at most, which are small enough to broadcast by that bound, and what comes to the
    driver are the hashed words of as many. Without labels every score is 0.5.
    """
    few = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")
    )
    few = few.orderBy(F.xxhash64(F.col("id").cast("string")), "label").limit(most_rows)
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), _chars(docs, chars_col, text_col))
    rows = rows.join(F.broadcast(few), F.col("doc") == F.col("id")).withColumn("h", F.xxhash64("text", "chars"))
    # an id may have any number of documents: their keys are counted out before their words
    keys = rows.select("id", "h", "label").distinct().orderBy(F.xxhash64(F.col("id").cast("string")), "h", "label").limit(most_rows)
    keys = materialize(keys.select(F.col("id").alias("_i"), F.col("h").alias("_h"), F.col("label").alias("_l")), "keys")
    rows = rows.join(F.broadcast(keys), (F.col("id") == F.col("_i")) & (F.col("h") == F.col("_h")) & (F.col("label") == F.col("_l")))
    rows = rows.select("label", "text", "chars", "id", "h")

    def run(batches):
        for b in batches:
            for lo, hi, of, bucket, x, stats in features(b.column(1), _rows(b.column(2))):
                cut = np.searchsorted(of, np.arange(hi - lo + 1))
                arrays = [
                    b.column(3).slice(lo, hi - lo).cast(pa.string()),
                    b.column(4).slice(lo, hi - lo),
                    b.column(0).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.float32())),
                    pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel(), pa.float32()), STATS).cast(pa.list_(pa.float32())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "h", "label", "bucket", "x", "stats"])

    got = rows.mapInArrow(run, "id string, h long, label int, bucket array<int>, x array<float>, stats array<float>")
    got = got.dropDuplicates(["id", "h", "label"]).toArrow()
    got = got.sort_by([("id", "ascending"), ("h", "ascending"), ("label", "ascending")]).combine_chunks()
    if not got.num_rows:
        return fit(np.zeros(0), *(np.zeros(0, int),) * 3, np.zeros((0, STATS)))
    lists = got.column("bucket").combine_chunks()
    of = np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy()))
    flat = lambda name: got.column(name).combine_chunks().flatten().to_numpy()
    stats = flat("stats").reshape(-1, STATS)
    return fit(got.column("label").to_numpy().astype(float), of, flat("bucket"), flat("x"), stats)


def _chars(docs: DataFrame, chars_col: str, text_col: str):
    known = F.col(chars_col).cast("double") if chars_col in docs.columns else F.length(text_col).cast("double")
    return known.alias("chars")


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """One row for each input row: id, score (0 to 1). Null and empty texts are scored by their statistics alone;
    a null length counts as 0. Repeated rows get equal scores; other columns are ignored; no rows give none."""
    # as plain arrays, which a task can read without this package
    shipped = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.linear, machine.factors, machine.mean, machine.scale))

    def run(batches):
        m = Machine(*shipped.value)
        for b in batches:
            out = np.zeros(b.num_rows)
            for lo, hi, of, bucket, x, stats in features(b.column(1), _rows(b.column(2))):
                raw, _ = _raw(m, hi - lo, of, bucket, x, _scaled(m, stats))
                out[lo:hi] = 1 / (1 + np.exp(-raw.clip(-30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), _chars(docs, chars_col, text_col))
    return rows.mapInArrow(run, f"id {kind}, score double")


def held_out(id_col):
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    out = score(docs, train(docs, labels))
    return out.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
