"""Text files that span many tasks: lines, chat messages and rows of delimited tables, whatever the split size.

Spark's text reader deals a file out by byte ranges and names each row's range, so a row is known by (file, range, place in
it). What a row means may depend on all rows before it: its number, the message it goes on with, whether it begins inside
quotes. Each range is summed up to one row, a window over a file's ranges turns these into what holds at each range's start, and
rows take it by a join on (file, range). No task needs more than a range and the rows of one record.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import units as u
from . import vocabulary as v

SAMPLE = 4096  # characters by which a table's dialect is told
MOST_HEADER = 1 << 16  # characters in which a header ends
MOST_HEADS = 50_000  # files whose dialects one broadcast holds; more are read in turn
OTHER_ENDS = "[\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """path, block (where the range begins), value: the physical lines, each range's in order within its task. Bad bytes are
    replaced; a byte order mark goes."""
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    value = F.regexp_replace(F.make_valid_utf8("value"), "^\ufeff", "").alias("value")
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), value)


def _runs(batch) -> tuple[np.ndarray, np.ndarray]:
    """Where the ranges of a batch begin and end."""
    path, block = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
    cut = np.flatnonzero((path[1:] != path[:-1]) | (block[1:] != block[:-1])) + 1
    return np.r_[0, cut], np.r_[cut, len(block)]


def _numbered(batches):
    """path, block, i (place in the range), text: also cut at the rarer line ends."""
    last, at = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        text = pc.if_else(pc.ends_with(b.column(2), "\r"), pc.utf8_slice_codeunits(b.column(2), 0, -1), b.column(2))
        rare = pc.match_substring_regex(text, OTHER_ENDS).to_numpy(zero_copy_only=False)
        times = np.ones(b.num_rows, np.int64)
        if rare.any():
            split = [t.as_py().splitlines() if r else None for t, r in zip(text, rare, strict=True)]
            times = np.array([1 if x is None else len(x) for x in split], np.int64)
            text = pa.array([y for t, x in zip(text, split, strict=True) for y in ([t.as_py()] if x is None else x)], pa.string())
        places = np.empty(times.sum(), np.int64)
        upto = np.r_[0, np.cumsum(times)]
        for lo, hi in zip(*_runs(b), strict=True):
            key = (b.column(0)[lo].as_py(), b.column(1)[lo].as_py())
            at = at if key == last else 0
            n = upto[hi] - upto[lo]
            places[upto[lo] : upto[hi]] = np.arange(at, at + n)
            last, at = key, at + n
        rows = pa.array(np.repeat(np.arange(b.num_rows), times))
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(places), text], ["path", "block", "i", "text"])


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """path, block, i, text: the lines, also cut at the rarer line ends."""
    rows = _raw(spark, path)
    return rows.mapInArrow(_numbered, "path string, block long, i long, text string")


def _before(blocks: DataFrame, *sums: str) -> DataFrame:
    """path, block and, for each sum, what the earlier ranges of the file add up to."""
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("path", "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums))


def lines(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """path, line (from 1), text (trimmed) of the lines with `least` characters or more."""
    rows = numbered(spark, path)
    before = _before(rows.groupBy("path", "block").agg(F.count("*").alias("n")), "n")
    bare = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    out = rows.join(before, ["path", "block"]).select("path", (F.col("n_before") + F.col("i") + 1).alias("line"), bare.alias("text"))
    return out.where(F.length("text") >= least)


def chat_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages and notices of chat exports: path, message (from 0), line, kind, stamp, sender (null for notices), body, media.

    A line that opens neither goes on with the message above, in an earlier range if need be; after a notice, or before any
    message, it is dropped. Blank lines are left out."""
    bare = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = numbered(spark, path).withColumn("bare", bare)
    kind = F.when(F.col("bare").rlike(v.CHAT_MESSAGE), "chat_message").when(F.col("bare").rlike(v.CHAT_NOTICE), "chat_system_notice")
    rows = rows.withColumn("kind", F.when(F.col("bare") != "", kind))
    opens = F.col("kind").isNotNull().cast("long")
    before = _before(rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.sum(opens).alias("m")), "n", "m")
    within = Window.partitionBy("path", "block").orderBy("i")
    rows = rows.withColumn("m", F.sum(opens).over(within)).join(before, ["path", "block"]).where("bare <> ''")
    part = lambda p, g: F.trim(F.regexp_extract("bare", p, g))
    is_message = F.col("kind") == "chat_message"
    rows = rows.select(
        "path", (F.col("m_before") + F.col("m") - 1).alias("message"), (F.col("n_before") + F.col("i") + 1).alias("line"), "kind",
        F.when(F.col("kind").isNotNull(), part(v.CHAT_NOTICE, 1)).alias("stamp"), F.when(is_message, part(v.CHAT_MESSAGE, 2)).alias("sender"),
        F.when(is_message, F.regexp_extract("bare", v.CHAT_MESSAGE, 3)).when(F.col("kind").isNotNull(), F.regexp_extract("bare", v.CHAT_NOTICE, 2)).otherwise(F.col("text")).alias("body"),
    ).where("message >= 0")
    got = rows.groupBy("path", "message").agg(
        F.min("line").alias("line"), F.max("kind").alias("kind"), F.max("stamp").alias("stamp"), F.max("sender").alias("sender"),
        F.array_sort(F.collect_list(F.struct("line", "body"))).alias("s"),
    )
    joined = F.array_join(F.transform("s", lambda x: x["body"]), "\n")
    body = F.when(F.col("kind") == "chat_message", joined).otherwise(F.col("s")[0]["body"])
    return got.select("path", "message", "line", "kind", "stamp", "sender", body.alias("body")).withColumn("media", F.col("body").rlike(v.MEDIA_OMITTED))


# --- delimited tables

HEAD = "path string, separator string, quote string, doubled boolean, skip boolean, header array<string>"


def _first_lines(batches):
    """The first lines of each range that may hold characters of its file's sample: path, block, i, value."""
    last, at, size = None, 0, 0
    for b in batches:
        keep, places = [], []
        for i, (path, block, value) in enumerate(zip(b["path"], b["block"], b["value"], strict=True)):
            if (path, block) != last:
                last, at, size = (path, block), 0, 0
            if size < MOST_HEADER:
                keep.append(i)
                places.append(at)
                at += 1
                size += len(value) + 1
        yield b.iloc[keep].assign(i=places)[["path", "block", "i", "value"]]


def _heads(batches):
    """The dialect and header of each file; rows come by file, in order."""
    path, held, size = None, [], 0

    def told():
        d = u.sniff("".join(x + "\n" for x in held)[:SAMPLE])
        header = next((r for r in csv.reader((x + "\n" for x in held), d) if r), [])
        return pd.DataFrame([(path, d.delimiter, d.quotechar or '"', bool(d.doublequote), bool(d.skipinitialspace), header)], columns=[c.split(" ")[0] for c in HEAD.split(", ")])

    for b in batches:
        for p, line in zip(b["path"], b["value"], strict=True):
            if p != path:
                if held:
                    yield told()
                path, held, size = p, [], 0
            if size < MOST_HEADER:
                held.append(line)
                size += len(line) + 1
    if held:
        yield told()


def _watched(lines, asked: list):
    for x in lines:
        yield x + "\n"
    asked.append(True)


def heads(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its dialect by the first SAMPLE characters and its header, of MOST_HEADER characters at most."""
    first = _raw(spark, path).where(F.col("block") < 4 * MOST_HEADER).mapInPandas(_first_lines, "path string, block long, i long, value string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return first.repartition(n, "path").sortWithinPartitions("path", "block", "i").select("path", "value").mapInPandas(_heads, HEAD)


def _reader(lines, separator: str, quote: str, doubled: bool, skip: bool):
    return csv.reader(lines, delimiter=separator, quotechar=quote, doublequote=doubled, skipinitialspace=skip)


def _ends_inside(line: str, inside: bool, dialect: tuple) -> bool:
    """Whether a table's reader is inside quotes behind a line, if it is or isn't before it."""
    asked: list = []
    next(_reader(_watched([(dialect[1] + line) if inside else line], asked), *dialect), None)
    return bool(asked)


def _speculate(batches):
    """For each line both cases, that its range begins outside (0) and inside quotes (1): whether it is inside before and after
    it, and how many rows have begun in the range up to it."""
    last, at, state, count = None, 0, [False, True], [0, 0]
    for b in batches:
        if not b.num_rows:
            continue
        n, text = b.num_rows, b.column(2)
        places, before, after = np.empty(n, np.int64), np.empty((2, n), bool), np.empty((2, n), bool)
        rows = np.empty((2, n), np.int64)
        blank = pc.is_in(text, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
        for lo, hi in zip(*_runs(b), strict=True):
            key = (b.column(0)[lo].as_py(), b.column(1)[lo].as_py())
            if key != last:
                last, at, state, count = key, 0, [False, True], [0, 0]
            dialect = tuple(b.column(c)[lo].as_py() for c in (3, 4, 5, 6))
            places[lo:hi] = np.arange(at, at + hi - lo)
            at += hi - lo
            quoted = lo + np.flatnonzero(pc.match_substring(text.slice(lo, hi - lo), dialect[1]).to_numpy(zero_copy_only=False))
            for h in (0, 1):
                i = lo
                for q in [*quoted, hi]:
                    before[h, i : min(q + 1, hi)] = after[h, i:q] = state[h]
                    if q < hi:
                        state[h] = _ends_inside(text[q].as_py(), state[h], dialect)
                        after[h, q] = state[h]
                    i = q + 1
                rows[h, lo:hi] = count[h] + np.cumsum(~before[h, lo:hi] & ~blank[lo:hi])
                count[h] = int(rows[h, hi - 1])
        arrays = [b.column(0), b.column(1), pa.array(places), text, *(pa.array(x[h]) for h in (0, 1) for x in (before, after, rows))]
        yield pa.RecordBatch.from_arrays(arrays, ["path", "block", "i", "text", "b0", "a0", "r0", "b1", "a1", "r1"])


def _states(blocks: DataFrame) -> DataFrame:
    """path, block, inside (at the range's start), rows_before. A range maps (outside, inside) to constants, to itself or to its
    opposite: what counts is the last constant one and how many turns followed."""
    order = Window.partitionBy("path").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.expr("a0 AND NOT a1").cast("long")).over(order), F.lit(0))
    out = blocks.withColumn("turns", turns)
    fixed = F.when(F.col("a0") == F.col("a1"), F.struct("turns", F.col("a0").cast("long").alias("value")))
    out = out.withColumns({"fix": F.last(fixed, ignorenulls=True).over(earlier), "turned": F.coalesce(F.lag("turns").over(order), F.lit(0))})
    value = F.coalesce(F.col("fix.value"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("fix.turns"), F.lit(0))
    out = out.withColumn("inside", value % 2 == 1)
    rows = F.when(F.col("inside"), F.col("r1")).otherwise(F.col("r0"))
    return out.withColumn("rows", rows).select("path", "block", "inside", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"))


def table_records(spark: SparkSession, path: str) -> DataFrame:
    """path, row (the header is 1), text (the record's physical lines), and the file's dialect and header: one row a record."""
    known = heads(spark, path)
    n = known.count()
    groups, out = -(-n // MOST_HEADS), None
    raw = _raw(spark, path)
    if groups > 1:
        raw, known = (d.withColumn("_g", F.pmod(F.xxhash64("path"), F.lit(groups))) for d in (raw, known))
    for g in range(max(1, groups)):
        some, mine = (raw.where(F.col("_g") == g), known.where(F.col("_g") == g).drop("_g")) if groups > 1 else (raw, known)
        # a broadcast of MOST_HEADS rows at most, and needed: it keeps the lines in their order
        spec = some.join(F.broadcast(mine), "path").select("path", "block", "value", "separator", "quote", "doubled", "skip")
        spec = spec.mapInArrow(_speculate, "path string, block long, i long, text string, b0 boolean, a0 boolean, r0 long, b1 boolean, a1 boolean, r1 long")
        ends = [F.max_by(c, "i").alias(c) for c in ("a0", "r0", "a1", "r1")]
        states = _states(spec.groupBy("path", "block").agg(*ends))
        pick = lambda x: F.when(F.col("inside"), F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
        rows = spec.join(states, ["path", "block"]).select(
            "path", "block", "i", "text", pick("b").alias("b"), pick("a").alias("a"), (F.col("rows_before") + pick("r")).alias("row")
        )
        rows = rows.where("NOT (NOT b AND text IN ('', '\\r')) AND row > 0")
        whole = rows.where("NOT a AND NOT b").select("path", "row", "text")
        pieces = rows.where("a OR b").groupBy("path", "row").agg(F.array_sort(F.collect_list(F.struct("block", "i", "text"))).alias("s"))
        pieces = pieces.select("path", "row", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text"))
        got = whole.unionByName(pieces).join(F.broadcast(mine), "path")
        out = got if out is None else out.unionByName(got)
    return out


def table_rows(spark: SparkSession, path: str, source_type: str | None = None) -> DataFrame:
    """Rows of delimited files of any size: path, source_type (by the header where none is declared), row, cells, fields. Rows
    end at line feeds, with or without a carriage return; bad bytes are replaced."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(u.MOST_FIELD)
        for pdf in batches:
            out, maps = [], {}
            for x in pdf.itertuples(index=False):
                header = list(x.header)
                kind = source_type or u.table_type(header if x.separator == "," else [x.separator.join(header)])
                key = (x.path, kind)
                if key not in maps:
                    maps[key] = v.map_columns(header, kind)
                row = next(_reader(io.StringIO(x.text, newline=""), x.separator, x.quote, x.doubled, x.skip), [])
                cells = {h: c.strip() for h, c in zip(header, row, strict=False) if h and c.strip()}
                if cells:
                    out.append((x.path, kind, x.row, cells, {f: cells[h] for f, h in maps[key].items() if h in cells}))
            yield pd.DataFrame(out, columns=["path", "source_type", "row", "cells", "fields"])

    rows = table_records(spark, path).where("row > 1")
    return rows.mapInPandas(parse, "path string, source_type string, row long, cells map<string,string>, fields map<string,string>")
