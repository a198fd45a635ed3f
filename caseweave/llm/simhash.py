"""SimHash near-duplicates with a Gray-order hierarchical index over the fingerprints.

Fingerprints are computed in Arrow batches. Distinct fingerprints are dealt to buckets that agree on one of
four 16-bit blocks (two fingerprints at 3 or fewer differing bits agree on at least one block whole).
Inside a bucket they are sorted by Gray rank, so neighbours share long bit patterns; nodes over runs of the
sorted order keep the bits all members share (mask and pattern), and pairs of nodes descend only while the
differences accumulated in the shared bits stay within the limit. A bucket over `hot_rows` is dealt again on
blocks of its remaining bits, twice at most, which is exact by the same argument. A bucket gives back only
one edge for each member and its smallest linked member, so a dense group costs its size and not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import free_names, materialize, table, within, without

LEAF, FANOUT, PAIRS = 8, 4, 32_768
_DIGEST = "concat_ws(':', xxhash64(cast({0} AS string)), hash(cast({0} AS string)))"
BLOCKS = (16, 12, 9)  # widths of the four blocks at each dealing


def word_blocks(data: bytes, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists from about a megabyte each."""
    i, n = 0, len(data)
    while i < n:
        j = min(n, i + step)
        while j < n and data[j] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            j += 1
        yield data[i:j].split()
        i = j


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text: a bit is 1 if set in over half of the hashes."""
    counts, n, tail = np.zeros(64, np.int64), 0, []

    def add(hashes: np.ndarray) -> None:
        nonlocal counts, n
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
        n += len(hashes)

    for block in word_blocks((text or b"").lower()):
        ws = tail + block
        if (k := len(ws) - width + 1) > 0:
            joined = map(b" ".join, zip(*(ws[i : k + i] for i in range(width)), strict=True))
            add(np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in joined), np.uint64, k))
        tail = ws[max(0, k) :]
    if not n and tail:
        add(np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0]) if n else 0


def _fingerprints(width: int):
    def run(batches):
        for b in batches:
            fps = [fingerprint(t, width) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    return run


def _merge(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of a[i] and b[i]; lab keeps for each element the smallest member of its class."""
    while True:
        la, lb = lab[a], lab[b]
        if not (m := la != lb).any():
            return
        a, b, la, lb = a[m], b[m], la[m], lb[m]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab[:] = nxt


def _expand(i: np.ndarray, j: np.ndarray, step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Child pairs of node pairs, each unordered pair once."""
    o = np.arange(step)
    ci = (i[:, None] * step + o)[:, :, None]
    cj = (j[:, None] * step + o)[:, None, :]
    ci, cj = np.broadcast_arrays(ci, cj)
    ci, cj = ci.ravel(), cj.ravel()
    ok = (ci <= cj) & (cj < n)
    return ci[ok], cj[ok]


def gray_classes(fps: np.ndarray, limit: int = 3) -> np.ndarray:
    """Classes of distinct uint64 fingerprints, sorted by Gray rank, under links of `limit` differing bits or fewer."""
    n = len(fps)
    lab = np.arange(n)
    if n < 2:
        return lab
    near = np.flatnonzero(np.bitwise_count(fps[1:] ^ fps[:-1]) <= limit)
    _merge(lab, near, near + 1)
    levels = []  # from the leaves up: pattern, mask of shared bits
    ands, ors, step = fps, fps, LEAF
    while True:
        cuts = np.arange(0, len(ands), step)
        ands, ors, step = np.bitwise_and.reduceat(ands, cuts), np.bitwise_or.reduceat(ors, cuts), FANOUT
        levels.append((ands, ~(ands ^ ors)))
        if len(ands) == 1:
            break
    cuts = np.arange(0, n, LEAF)
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        at, i, j = stack.pop()
        pattern, mask = levels[at]
        keep = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= limit
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if at:
            ci, cj = _expand(i, j, FANOUT, len(levels[at - 1][0]))
            stack += [(at - 1, ci[k : k + PAIRS], cj[k : k + PAIRS]) for k in range(0, len(ci), PAIRS)]
            continue
        low, high = np.minimum.reduceat(lab, cuts), np.maximum.reduceat(lab, cuts)
        open_ = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))  # else already one class
        a, b = _expand(i[open_], j[open_], LEAF, n)
        hit = (a < b) & (lab[a] != lab[b])
        a, b = a[hit], b[hit]
        hit = np.bitwise_count(fps[a] ^ fps[b]) <= limit
        _merge(lab, a[hit], b[hit])
    return lab


def _bucket_edges(limit: int):
    """Edges (u, v) of each bucket; rows come sorted by bucket and Gray rank, and a bucket may span batches."""

    def flush(bucket: np.ndarray, fp: np.ndarray):
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        us, vs = [], []
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            if hi - lo == 2:
                if (int(fp[lo]) ^ int(fp[lo + 1])).bit_count() <= limit:
                    us.append(fp[lo + 1 : hi])
                    vs.append(fp[lo : lo + 1])
            elif hi - lo > 2:
                part = fp[lo:hi]
                lab = gray_classes(part, limit)
                linked = np.flatnonzero(lab != np.arange(hi - lo))
                us.append(part[linked])
                vs.append(part[lab[linked]])
        cat = lambda xs: pa.array((np.concatenate(xs) if xs else np.zeros(0, np.uint64)).view(np.int64))
        return pa.RecordBatch.from_arrays([cat(us), cat(vs)], ["u", "v"])

    def run(batches):
        held_b, held_f = [], []
        for batch in batches:
            b = batch.column(0).to_numpy()
            f = batch.column(1).to_numpy().view(np.uint64)
            if not len(b):
                continue
            last = int(np.searchsorted(b, b[-1]))  # the bucket that may go on in the next batch
            if last:
                yield flush(np.concatenate([*held_b, b[:last]]), np.concatenate([*held_f, f[:last]]))
                held_b, held_f = [b[last:]], [f[last:]]
            elif held_b and held_b[-1][-1] != b[0]:
                yield flush(np.concatenate(held_b), np.concatenate(held_f))
                held_b, held_f = [b], [f]
            else:
                held_b, held_f = [*held_b, b], [*held_f, f]
        if held_b:
            yield flush(np.concatenate(held_b), np.concatenate(held_f))

    return run


def _deal(rows: DataFrame, width: int) -> DataFrame:
    """Four rows for each row (bucket, fp, rest): one for each block of `rest` that others may share whole."""
    rest, picks = F.col("rest"), []
    for k in range(4):
        at = k * width
        value = F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << width) - 1))
        bucket = F.shiftleft(F.col("bucket"), width + 2).bitwiseOR(F.lit(k << width)).bitwiseOR(value)
        above = F.shiftleft(F.shiftrightunsigned(rest, at + width), at) if at + width < 64 else F.lit(0)
        below = rest.bitwiseAND(F.lit((1 << at) - 1)) if at else F.lit(0)
        picks.append(F.struct(bucket.cast("long").alias("bucket"), above.bitwiseOR(below).cast("long").alias("rest")))
    return rows.select("fp", F.explode(F.array(*picks)).alias("p")).select("p.bucket", "fp", "p.rest")


def _gray_rank(fp):
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def links(fps: DataFrame, limit: int = 3, hot_rows: int = 16_384) -> DataFrame:
    """Spanning edges (u, v) of the classes of distinct fingerprints `fps` (fp: long)."""
    if not 0 <= limit <= 3:
        raise ValueError("four blocks prove links of at most 3 differing bits")
    rows = _deal(fps.select("fp", F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("rest")), BLOCKS[0])
    ready = []
    for width in (*BLOCKS[1:], 0):
        hot = rows.groupBy("bucket").count().where(F.col("count") > hot_rows).select("bucket") if width else None
        if hot is None or not (hot := materialize(hot, "hot")).take(1):
            ready.append(rows)
            break
        ready.append(rows.join(hot, "bucket", "left_anti"))
        rows = _deal(rows.join(hot, "bucket", "left_semi"), width)
    edges = None
    for part in ready:
        n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        out = (
            part.select("bucket", "fp")
            .repartition(n, "bucket")
            .sortWithinPartitions("bucket", _gray_rank(F.col("fp")))
            .mapInArrow(_bucket_edges(limit), "u long, v long")
        )
        edges = out if edges is None else edges.unionByName(out)
    return edges


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, limit: int = 3, hot_rows: int = 16_384,
    with_digest: bool = False,
) -> DataFrame:
    """One row for each input row: id, fp (long), root (fp of the class), component_id (smallest id of the class) and, if asked
    for, digest (two checksums of the text).

    Null and blank texts have fingerprint zero and link like any other. Equal texts share a fingerprint.
    Repeated rows give repeated output rows. A null id takes part in linking but is never a smallest id
    unless its class has no other, then component_id is null. An empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(
        F.struct(F.col(id_col).alias("id"), *([F.expr(_DIGEST.format(f"`{text_col}`")).alias("digest")] if with_digest else [])).alias("id"),
        F.col(text_col).cast("string").alias("text"),
    )
    extra = ",digest:string" if with_digest else ""
    rows = materialize(narrow.mapInArrow(_fingerprints(width), f"id struct<id:{kind}{extra}>, fp long").select("id.*", "fp"), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = materialize(connected_components(links(fps, limit, hot_rows)), "roots")
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(named.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "classes")
    return rows.join(classes, rows.fp == classes._fp, "left").select("id", "fp", "root", "component_id", *(["digest"] if with_digest else []))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Keep one row of each class of near-duplicates: of the rows with the smallest id, null last, the one whose text has the
    smallest checksums; of rows that repeat both, one. All columns stay. No two texts are taken for one by their id."""
    found = simhash_components(docs, id_col, text_col, with_digest=True, **options)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    first = found.groupBy("root").agg(F.min(order).alias("x"), F.count("*").alias("n")).select("root", "x.id", "x.digest", "n")
    # rows that go: those of classes of several rows that aren't the first; equal rows of the first go but for one
    several = first.where("n > 1").select(F.col("root").alias("_r"), F.col("id").alias("_i"), F.col("digest").alias("_d"))
    rows = found.join(several, F.col("root") == F.col("_r"))
    is_first = F.col("id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d"))
    gone = materialize(rows.groupBy("id", "digest").agg(F.max(is_first).alias("first"), F.count("*").alias("n")), "gone")
    key = [F.col(id_col), F.expr(_DIGEST.format(f"`{text_col}`"))]
    kept = without(docs, gone.where("NOT first OR n > 1"), key, ["id", "digest"])
    again = gone.where("first AND n > 1")
    if not again.take(1):
        return kept
    (n,) = free_names(docs.columns, "_cw_n")
    repeated = within(docs, again, key, ["id", "digest"]).withColumn(n, key[1]).dropDuplicates([id_col, n]).drop(n)
    return kept.unionByName(repeated)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
