"""Alignment of two tokenizations of a text by sparse token-byte incidence matrices.

A text's tokens form a matrix A (tokens by bytes, 1 where a token covers a byte), the other tokenizer's a matrix B. Both are
held as CSR arrays built here; Gustavson's row products A·Bᵀ are the overlap links, whose values are shared bytes. Byte
offsets where tokens of both sides end cut the text into groups; the products of the group incidences are the shared-group
links. Both products have runs of consecutive columns in each row, so a row is stored as its first and last column: a group
of many tokens costs its tokens and not its pairs.

The corpus-wide count of an id pair takes three steps. Tasks tokenize once and write, for each chunk of half a megabyte of
text, its documents with their links as places in the chunk's list of distinct pairs, and that list with its document counts.
The lists are summed by pair. The sums go back to the chunks that asked, so a task holds one chunk's pairs and never the
corpus's.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize, table

CHUNK = 1 << 19  # bytes of text
BLOCK = 1 << 17  # products of a block of rows
PATHS = ("/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model")
#: How a byte-level tokenizer of this kind cuts a text before merging (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Csr:
    """Rows `ptr[i]:ptr[i + 1]` of `cols`; all values are 1 if `vals` is None."""

    ptr: np.ndarray
    cols: np.ndarray
    width: int
    vals: np.ndarray | None = None


def incidence(ends: np.ndarray) -> Csr:
    """Tokens by bytes, from the tokens' ends."""
    n = int(ends[-1]) if len(ends) else 0
    return Csr(np.r_[0, ends].astype(np.int64), np.arange(n, dtype=np.int32), n)


def transposed(m: Csr) -> Csr:
    """The transpose of a matrix of ones."""
    rows = np.repeat(np.arange(len(m.ptr) - 1, dtype=np.int32), np.diff(m.ptr))
    order = np.argsort(m.cols, kind="stable") if np.any(m.cols[1:] < m.cols[:-1]) else slice(None)
    return Csr(np.r_[0, np.cumsum(np.bincount(m.cols, minlength=m.width))], rows[order], len(m.ptr) - 1)


def product(a: Csr, b: Csr) -> Csr:
    """A·B of matrices of ones by Gustavson's rows, a block of rows at a time; values count."""
    per = b.ptr[a.cols + 1] - b.ptr[a.cols]  # entries of B that each entry of A meets
    upto = np.r_[0, np.cumsum(per)][a.ptr]
    n, at, ptr, cols, vals = len(a.ptr) - 1, 0, [np.zeros(1, np.int64)], [], []
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, side="right")) - 1)
        lo, hi = a.ptr[at], a.ptr[to]
        k = per[lo:hi]
        first = np.repeat(b.ptr[a.cols[lo:hi]] - np.r_[0, np.cumsum(k)[:-1]] if len(k) else k, k)
        row = np.repeat(np.repeat(np.arange(to - at), np.diff(a.ptr[at : to + 1])), k)
        col = b.cols[first + np.arange(len(first))]
        key = row * np.int64(b.width) + col
        if np.any(key[1:] < key[:-1]):
            key = np.sort(key)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        key = key[new]
        row, col = np.divmod(key, max(1, b.width))
        ptr.append(np.cumsum(np.bincount(row, minlength=to - at)) + ptr[-1][-1])
        cols.append(col.astype(np.int32))
        vals.append(np.diff(np.r_[new, upto[to] - upto[at]]).astype(np.int32))
        at = to
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int32)
    return Csr(np.concatenate(ptr), cat(cols), b.width, cat(vals))


def groups_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(group of each A token, of each B token, number of groups)."""
    both = np.intersect1d(a_ends, b_ends, assume_unique=True)
    return np.searchsorted(both, a_ends), np.searchsorted(both, b_ends), len(both)


def group_rows(a_group: np.ndarray, b_group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the product of the group incidences: each A token's B tokens, as (from, to)."""
    of = np.r_[0, np.cumsum(np.bincount(b_group, minlength=n))]
    return of[a_group], of[a_group + 1]


# --- tokenizers

NONE = np.zeros(0, np.uint32)

class Vocabulary:
    """Both tokenizers, built from the bytes of their files, and the bytes of their entries."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(byte_file)
        vocab, model = spec["model"]["vocab"], spec["model"]
        special = {t["content"] for t in spec.get("added_tokens", ())}
        table_ = _byte_letters()
        raw = {bytes(table_[c] for c in k): v for k, v in vocab.items() if k not in special}
        self.bytes_a = [b""] * (1 + max(v for v in vocab.values()))
        for k, v in raw.items():
            self.bytes_a[v] = k
        ranked = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = spec.get("normalizer") is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True)
        if not plain or spec["pre_tokenizer"].get("add_prefix_space") or ranked != sorted(ranked):
            raise ValueError("a byte-level tokenizer whose ids ascend in the order of its merges is expected")
        self._a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=raw, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        piece = self._b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self._b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self._b.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if the text is null or empty, or either side's bytes aren't those of space and text."""
        if not text:
            return NONE, NONE
        whole = f" {text}"
        a, b, raw = self._a.encode_to_numpy(whole, disallowed_special=()), self._b.encode(text), whole.encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != raw or b"".join(map(self.bytes_a.__getitem__, a.tolist())) != raw:
            return NONE, NONE
        return a, np.array(b, np.uint32)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = {chr(b): b for b in shown}, 256
    for b in range(256):
        if b not in shown:
            out[chr(more)] = b
            more += 1
    return out


def _shipped(spark: SparkSession, paths: tuple[str, str]):
    """The tokenizer files' bytes, a few megabytes by nature, sent to the executors."""
    return spark.sparkContext.broadcast(tuple(Path(p).read_bytes() for p in paths))


# --- chunks


@dataclass
class Chunk:
    """The tokens of some texts end to end, their links and groups; `a_of`, `b_of`: where each text's tokens begin."""

    a: np.ndarray
    b: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    n_groups: int
    links: Csr


def chunk_of(texts: list[str | None], v: Vocabulary) -> Chunk:
    pairs = [v.tokens(t) for t in texts]
    a, b = (np.concatenate([p[s] for p in pairs]).astype(np.int64) for s in (0, 1))
    a_of, b_of = (np.r_[0, np.cumsum([len(p[s]) for p in pairs])].astype(np.int64) for s in (0, 1))
    a_ends, b_ends = np.cumsum(v.len_a[a]), np.cumsum(v.len_b[b])
    ga, gb, n = groups_of(a_ends, b_ends)
    return Chunk(a, b, a_of, b_of, ga, gb, n, product(incidence(a_ends), transposed(incidence(b_ends))))


def _chunks(texts: pa.Array, v: Vocabulary):
    """(from, to, chunk) over texts of about CHUNK bytes, one text at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    upto, at = np.r_[0, np.cumsum(sizes, dtype=np.int64)], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + CHUNK, side="right")) - 1)
        yield at, to, chunk_of(texts.slice(at, to - at).to_pylist(), v)
        at = to


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0 to n - 1, left-aligned with room for a sign behind, and how many there are."""
    text = np.array([str(i) for i in range(n)], "S")
    wide = text.dtype.itemsize
    return np.c_[np.frombuffer(text.tobytes(), np.uint8).reshape(n, wide), np.zeros(n, np.uint8)], np.char.str_len(text)


def group_texts(c: Chunk, digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
    """For each text its groups as `a1,a2|b1;a3|b2,b3`."""
    n_a, n_b = len(c.a), len(c.b)
    of_a, of_b = np.bincount(c.a_group, minlength=c.n_groups), np.bincount(c.b_group, minlength=c.n_groups)
    before_b, upto_a = np.r_[0, np.cumsum(of_b)], np.cumsum(of_a)
    ids, sign = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
    a_at, b_at = np.arange(n_a) + before_b[c.a_group], np.arange(n_b) + upto_a[c.b_group]
    ids[a_at], ids[b_at] = c.a, c.b
    sign[a_at[upto_a - 1]] = ord("|")
    sign[b_at[before_b[1:] - 1]] = ord(";")
    out, ends = [], c.a_of + c.b_of
    for i in range(len(ends) - 1):
        lo, hi, parts = ends[i], ends[i + 1], []
        for k in range(lo, hi, BLOCK):
            part = slice(k, min(hi, k + BLOCK))
            rows, size = digits[0][ids[part]], digits[1][ids[part]]
            rows[np.arange(len(rows)), size] = sign[part]
            parts.append(rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes())
        out.append(b"".join(parts)[:-1])
    return out


COLUMNS = "chunk long, id {kind}, is_list boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, wide int, pairs array<long>, docs array<long>"


def _first_pass(shipped):
    def run(batches):
        v, seq, task = Vocabulary(*shipped.value), 0, TaskContext.get().partitionId()
        digits = _decimals(max(len(v.bytes_a), len(v.bytes_b)))
        for batch in batches:
            for lo, hi, c in _chunks(batch.column(1), v):
                n = hi - lo
                chunk = (task << 32) | seq
                seq += 1
                row = np.repeat(np.arange(len(c.a)), np.diff(c.links.ptr))
                pair = (c.a[row] << 32) | c.b[c.links.cols]
                link_of = c.links.ptr[c.a_of]
                pairs, place = np.unique(pair, return_inverse=True)
                doc = np.repeat(np.arange(n), np.diff(link_of))
                once = np.sort(doc * np.int64(max(1, len(pairs))) + place)
                once = once[np.r_[True, once[1:] != once[:-1]]] if len(once) else once
                docs = np.bincount(once % max(1, len(pairs)), minlength=len(pairs))
                wide = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
                place = place.astype(wide)
                shas = [hashlib.sha256(t).hexdigest() if t else "" for t in group_texts(c, digits)]
                upto, has = np.zeros(n, np.int64), np.diff(c.a_of) > 0
                upto[has] = c.a_group[c.a_of[1:][has] - 1] + 1
                group_of = np.r_[0, np.maximum.accumulate(upto)]
                counts = [np.r_[np.diff(x), 0] for x in (c.a_of, c.b_of, group_of, link_of)]
                none = lambda t: pa.nulls(1, t)
                ids = pa.concat_arrays([batch.column(0).slice(lo, n), none(batch.column(0).type)])
                lists = lambda x: pa.concat_arrays([pa.nulls(n, pa.list_(pa.int64())), pa.array([x], pa.list_(pa.int64()))])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n + 1, chunk)), ids, pa.array(np.r_[np.zeros(n, bool), True]), *map(pa.array, counts), pa.array([*shas, None], pa.string()),
                        pa.array([*(place[link_of[i] : link_of[i + 1]].tobytes() for i in range(n)), None], pa.binary()),
                        pa.array(np.full(n + 1, wide().itemsize, np.int32)), lists(pairs), lists(docs),
                    ],
                    ["chunk", "id", "is_list", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "wide", "pairs", "docs"],
                )

    return run


def _second_pass(batches):
    """Rows come by chunk, each chunk's list of sums before its documents."""
    docs = best = np.zeros(0, np.int64)
    for b in batches:
        keep, n_best, total = [], [], []
        lists, wide, places, sums, tops = (b.column(i) for i in (1, 2, 3, 4, 5))
        for i, is_list in enumerate(lists.to_pylist()):
            if is_list:
                docs, best = (x.slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (sums, tops))
                continue
            at = np.frombuffer(places[i].as_py(), np.uint16 if wide[i].as_py() == 2 else np.uint32)
            keep.append(i)
            n_best.append(int(best[at].sum()))
            total.append(int(docs[at].sum()))
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], ["row", "n_best", "count_sum"])


def pair_counts(first: DataFrame) -> DataFrame:
    """pair (A id in the upper 32 bits), docs (documents that hold it linked), best (whether no pair of its A id has more)."""
    lists = first.where("is_list").select(F.explode(F.arrays_zip("pairs", "docs")).alias("x"))
    counts = lists.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.docs").alias("docs"))
    counts = materialize(counts, "pairs")
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("top"))  # one row an entry of A's vocabulary
    out = counts.join(F.broadcast(top), a == top.a).select("pair", "docs", (F.col("docs") == F.col("top")).alias("best"))
    out._cw_path = counts._cw_path
    return out


def link_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = PATHS) -> DataFrame:
    """One row for each input row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts that either tokenizer doesn't give back byte for byte, have zeros and an empty digest.
    Repeated rows count as documents of their own; the id, null or not, only names the row. A text of any length is tokenized
    whole, and its products are taken a block of rows at a time. Other columns are ignored, whatever their names; no rows give none.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    first = materialize(rows.mapInArrow(_first_pass(_shipped(docs.sparkSession, paths)), COLUMNS.format(kind=kind)), "aligned")
    counts = pair_counts(first)
    asked = first.where("is_list").select("chunk", F.posexplode("pairs").alias("place", "pair"))
    named = asked.join(counts, "pair").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("place", "docs", "best"))).alias("s"))
    digest = F.struct("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").alias("row")
    texts = first.where("NOT is_list").select("chunk", digest, F.lit(False).alias("is_list"), "wide", "places")
    texts = texts.withColumns({"sums": F.lit(None).cast("array<long>"), "tops": F.lit(None).cast("array<int>")})
    row = texts.schema["row"].dataType.simpleString()
    lists = named.select(
        "chunk", F.lit(None).cast(row).alias("row"), F.lit(True).alias("is_list"), F.lit(None).cast("int").alias("wide"), F.lit(None).cast("binary").alias("places"),
        F.col("s.docs").alias("sums"), F.transform("s", lambda x: x["best"].cast("int")).alias("tops"),
    )
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = texts.unionByName(lists).repartition(n, "chunk").sortWithinPartitions("chunk", F.desc("is_list"))
    out = both.select("row", "is_list", "wide", "places", "sums", "tops").mapInArrow(_second_pass, f"row {row}, n_best long, count_sum long")
    return out.select("row.*", "n_best", "count_sum")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str] = PATHS) -> DataFrame:
    """One row for each input row: id, a, b (token ids), a_group, b_group (group of each token), overlap and shared: for each
    A token the run of B tokens (`from`, `to`) that share bytes with it, and that share its group. Cases as in link_statistics."""
    shipped = _shipped(docs.sparkSession, paths)
    kind = docs.schema[id_col].dataType.simpleString()
    run_ = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))

    def runs(lo, hi):
        return [{"from": int(x), "to": int(y)} for x, y in zip(lo, hi)]

    def run(batches):
        v = Vocabulary(*shipped.value)
        for batch in batches:
            out = [[] for _ in range(6)]
            for text in batch.column(1).to_pylist():
                c = chunk_of([text], v)
                lo, hi = group_rows(c.a_group, c.b_group, c.n_groups)
                cols = c.links.cols
                first, last = (cols[c.links.ptr[:-1]], cols[c.links.ptr[1:] - 1] + 1) if len(c.a) else (lo, hi)
                for o, x in zip(out, (c.a, c.b, c.a_group, c.b_group, runs(first, last), runs(lo, hi)), strict=True):
                    o.append(x)
            arrays = [pa.array(x, pa.list_(pa.int32())) for x in out[:4]] + [pa.array(x, run_) for x in out[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "a", "b", "a_group", "b_group", "overlap", "shared"])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    span = "array<struct<from: int, to: int>>"
    return rows.mapInArrow(run, f"id {kind}, a array<int>, b array<int>, a_group array<int>, b_group array<int>, overlap {span}, shared {span}")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_statistics(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
