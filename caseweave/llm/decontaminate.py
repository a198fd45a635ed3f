"""Benchmark decontamination by winnowing.

Of every `span - k + 1` consecutive k-word hashes the smallest (the last of equals) is kept, on both sides,
so that any `span` shared words share a kept hash. Kept document hashes that pass a bit filter of the
benchmark's (a bitmap of bounded size; it only saves shuffling) are joined to the benchmark's in Spark and
extended over the words around them: a hit counts if the words of a whole window agree. Items shorter than
the span are one window, kept whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import materialize, table, without

LEAST_BITS, MOST_BITS = 1 << 13, 1 << 27
_CANDIDATE = "array<struct<p:int,m:int,fp:long,ctx:array<long>>>"


def winnow(gram: np.ndarray, row_of: np.ndarray, span: int, k: int) -> np.ndarray:
    """Positions of the hashes to keep: in each window inside a row the last of the smallest."""
    w = span - k + 1
    if len(row_of) < span:
        return np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(gram, w)
    at = np.flatnonzero(row_of[: len(windows)] == row_of[span - 1 :])
    out = []
    for i in range(0, len(at), 1 << 18):
        part = at[i : i + (1 << 18)]
        out.append(part + w - 1 - windows[part][:, ::-1].argmin(axis=1))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _candidates(h: np.ndarray, r: np.ndarray, span: int, k: int, pad: int, short=(), passes=None):
    """(row, place, length, hash, words around it) of kept hashes; short: lengths of shorter items to look for."""
    n, rows = len(h), np.diff(r)
    row_of = np.repeat(np.arange(len(rows)), rows)
    for m in (span, *short):
        if m == span:
            gram = tokens.grams(h, k)
            p = winnow(gram, row_of, span, k)
        else:
            gram = tokens.mix64(tokens.grams(h, m) + np.uint64(m))
            p = np.flatnonzero(row_of[: len(gram)] == row_of[m - 1 :]) if len(gram) else np.zeros(0, np.int64)
        fp = gram[p]
        if passes is not None and len(p):
            ok = passes(fp)
            p, fp = p[ok], fp[ok]
        if not len(p):
            continue
        reach = np.arange(k - span, span) if m == span else np.arange(m)
        pos = p[:, None] + reach
        ok = (pos >= 0) & (pos < n)
        pos = np.clip(pos, 0, n - 1)
        ok &= row_of[pos] == row_of[p][:, None]
        yield row_of[p], p - r[row_of[p]], m, fp, np.where(ok, h[pos], np.uint64(pad))


def _column(found: list, rows: int) -> pa.Array:
    """Arrow array<struct<p,m,fp,ctx>> for each row."""
    i32, i64 = pa.int32(), pa.int64()
    if found:
        row = np.concatenate([f[0] for f in found])
        order = np.argsort(row, kind="stable")
        p = np.concatenate([f[1] for f in found])[order]
        m = np.repeat([f[2] for f in found], [len(f[0]) for f in found])[order]
        fp = np.concatenate([f[3] for f in found])[order]
        wide = np.repeat([f[4].shape[1] for f in found], [len(f[0]) for f in found])
        flat = np.concatenate([f[4].ravel() for f in found])
        starts = np.r_[0, np.cumsum(wide)][:-1]
        take = np.concatenate([np.arange(starts[o], starts[o] + wide[o]) for o in order]) if len(found) > 1 else None
        ctx = flat[take] if take is not None else flat.reshape(len(order), -1)[order].ravel()
        ends, counts = np.r_[0, np.cumsum(wide[order])], np.bincount(row, minlength=rows)
    else:
        p = m = fp = ctx = np.zeros(0, np.int64)
        ends, counts = np.zeros(1), np.zeros(rows, int)
    lists = pa.ListArray.from_arrays(pa.array(ends, i32), pa.array(ctx.view(np.int64), i64))
    struct = pa.StructArray.from_arrays(
        [pa.array(p, i32), pa.array(m, i32), pa.array(fp.view(np.int64), i64), lists], ["p", "m", "fp", "ctx"]
    )
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], i32), struct)


def _scan(span: int, k: int, pad: int, short=None, bitmap=None):
    """Arrow batches (id, text) to (id, n_words, candidates). With short=None a row is an item: a short one is kept whole."""

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint8) if bitmap is not None else None

        def passes(fp):
            at = fp & np.uint64(len(bits) * 8 - 1)
            return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for batch in batches:
            data, offs = tokens.texts(batch.column(1))
            for lo, hi in tokens.slices(offs):
                o = offs[lo : hi + 1]
                low = tokens.LOWER[data[o[0] : o[-1]]]
                h, _, _, r = tokens.words(low, o - o[0], tokens.ALNUM)
                rows = np.diff(r)
                if short is None:
                    found = list(_candidates(h, r, span, k, pad))
                    for m in set(rows[(rows > 0) & (rows < span)].tolist()):
                        one = np.flatnonzero(rows == m)
                        hs = np.concatenate([h[r[i] : r[i + 1]] for i in one])
                        for row, p, mm, fp, ctx in _candidates(hs, np.arange(len(one) + 1) * m, span, k, pad, (m,)):
                            found.append((one[row], p, mm, fp, ctx))
                else:
                    found = list(_candidates(h, r, span, k, pad, short, passes if bits is not None else None))
                ids = batch.column(0).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.int64()), _column(found, hi - lo)], ["id", "n_words", "cands"])

    return run


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = 13,
    k: int = 5,
) -> DataFrame:
    """One row for each document row: id, digest (of the text), n_words, n_hit, items (array<string>, sorted as
    strings), spans (array of hit word ranges [s, e)).

    Words are runs of letters of any script and digits, lower-cased in A-Z. Null and wordless texts have no
    words and no hits; wordless items have no windows; items with a null id hit but are not listed. Repeated
    documents give repeated rows, repeated items count once. Long texts are read whole. Empty tables of
    either kind give rows without hits, or no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    bench = (
        items.mapInArrow(_scan(span, k, 2), f"id string, n_words long, cands {_CANDIDATE}")
        .select("id", F.explode("cands").alias("c"))
        .groupBy(F.col("c.fp").alias("b_fp"), F.col("c.m").alias("b_m"), F.col("c.ctx").alias("b_ctx"))
        .agg(F.collect_set("id").alias("items"))
    )
    bench = materialize(bench, "benchmark")
    short = sorted(r.b_m for r in bench.where(F.col("b_m") < span).select("b_m").distinct().collect())
    n = bench.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * n).bit_length()))
    place = F.col("b_fp").bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    set_ = bench.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(one).alias("b"))
    got = set_.toArrow()  # at most MOST_BITS / 64 rows of 16 bytes
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[got.column("i").to_numpy()] = got.column("b").to_numpy()
    shipped = spark.sparkContext.broadcast(bitmap.tobytes())

    narrow = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest")).alias("id"), text.alias("text"))
    scanned = narrow.mapInArrow(
        _scan(span, k, 1, tuple(short), shipped), f"id struct<id:{kind},digest:long>, n_words long, cands {_CANDIDATE}"
    )
    rows = materialize(scanned.withColumn("row", F.monotonically_increasing_id()), "candidates")
    joined = rows.select("row", F.explode("cands").alias("c")).join(
        bench, (F.col("c.fp") == F.col("b_fp")) & (F.col("c.m") == F.col("b_m"))
    )
    # a window that holds the shared hash starts 0 to span - k words before it
    starts = F.filter(
        F.sequence(F.lit(0), F.when(F.col("c.m") == span, span - k).otherwise(0)),
        lambda j: F.slice(F.col("c.ctx"), j + 1, F.col("c.m")) == F.slice("b_ctx", j + 1, F.col("c.m")),
    )
    first = F.col("c.p") - F.when(F.col("c.m") == span, span - k).otherwise(0)
    hits = joined.withColumn("starts", starts).where(F.size("starts") > 0)
    hits = hits.select(
        "row", "items", F.transform("starts", lambda j: F.struct((first + j).alias("s"), (first + j + F.col("c.m")).alias("e"))).alias("found")
    )
    by_row = hits.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("found"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    cover = F.aggregate(
        "found",
        zero,
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")
        ),
    )["n"]
    by_row = by_row.select(F.col("row").alias("_row"), "items", F.col("found").alias("spans"), cover.cast("long").alias("n_hit"))
    out = rows.select("row", "id.id", "id.digest", "n_words").join(by_row, F.col("row") == F.col("_row"), "left")
    return out.select(
        "id",
        "digest",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
    )


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def clean_of(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated (a twentieth of their words hit), columns as they were."""
    bad = contamination(docs, benchmark, id_col, text_col, **options).where(CONTAMINATED)
    return without(docs, bad, [F.col(id_col), F.xxhash64(F.col(text_col).cast("string"))], ["id", "digest"])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)
), ms AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i + 1 : i + m], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM d, ms)
), h AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
p AS (SELECT doc_id, count(DISTINCT i + x) AS n_hit FROM (SELECT DISTINCT doc_id, m, i FROM h) s, LATERAL (SELECT unnest(range(0, s.m)) AS x) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
"""
