"""Evidence files into records: text, delimited tables, e-mail, chat exports; type detection; content hashes.

Whole files arrive through Spark's binaryFile and text readers, so any store that Spark reads will do. A file is one
row while it is parsed, and the size limit of ingest keeps that row small.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import units
from . import vocabulary as v

MOST_BYTES = 10 * 1024 * 1024


def ingest(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files under `path`: path, name, extension, length, sha256, mime and content; oversized ones have status rejected and
    no content; Spark passes over empty ones. Equal contents are kept: `duplicate_of` names the first path with the same hash."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fits = F.col("length") <= most_bytes
    out = raw.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("extension"),
        "length", F.when(fits, F.sha2("content", 256)).alias("sha256"), sniff_mime(F.col("content")).alias("mime"),
        F.when(fits, F.col("content")).alias("content"), F.when(fits, "accepted").otherwise("rejected").alias("status"),
    )
    first = out.where("sha256 IS NOT NULL").groupBy(F.col("sha256").alias("_h")).agg(F.min("path").alias("_first"))
    out = out.join(first, F.col("sha256") == F.col("_h"), "left")
    return out.withColumn("duplicate_of", F.when(F.col("_first") != F.col("path"), F.col("_first"))).drop("_h", "_first")


def sniff_mime(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return (
        F.when(head.startswith("255044462D"), "application/pdf")
        .when(head.startswith("89504E47"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("504B0304"), "application/zip")
        .otherwise("text/plain")
    )


def lines(files: DataFrame) -> DataFrame:
    """One record for each non-blank line of valid UTF-8 files: path, line (from 1), text (without white space around it). Other
    files fail as a whole: see unreadable."""
    text = F.decode("content", "UTF-8")
    valid = files.where(F.is_valid_utf8(F.col("content").cast("string")))
    rows = valid.select("path", F.posexplode(F.split(text, "\r?\n")).alias("i", "raw"))
    return rows.select("path", (F.col("i") + 1).alias("line"), F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("text")).where("text <> ''")


def unreadable(files: DataFrame) -> DataFrame:
    """path and error of the files whose text can't be read, so that a run fails for them and not silently."""
    bad = files.where("content IS NOT NULL").where(~F.is_valid_utf8(F.col("content").cast("string")))
    return bad.select("path", F.lit("not valid UTF-8").alias("error"))


def paragraphs(files: DataFrame, least: int = 3) -> DataFrame:
    return lines(files).where(F.length("text") >= least)


def _each(files: DataFrame, read, schema: str, columns: list[str]) -> DataFrame:
    """read(content) for each file, its rows behind the path; a file that fails gives a row with its error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                try:
                    out += [(path, *r, None) for r in read(bytes(content))]
                except Exception as e:  # a bad file is a row and not the job's end
                    out.append((path, *(None for _ in columns), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", *columns, "error"])

    return files.select("path", "content").where("content IS NOT NULL").mapInPandas(parse, f"path string, {schema}, error string")


def chat_messages(files: DataFrame) -> DataFrame:
    """Messages of chat exports: path, line, stamp, sender (null for notices), body, media, error. A line that opens no message
    continues the one before it. Files over many tasks: see splits."""

    def read(content: bytes):
        for x in units.chat_units(units.lines_of(io.BytesIO(content))):
            yield x["line"], x["fields"]["event_time"], x["fields"].get("sender"), x["text"], bool(re.search(v.MEDIA_OMITTED, x["text"]))

    return _each(files, read, "line int, stamp string, sender string, body string, media boolean", ["line", "stamp", "sender", "body", "media"])


map_columns = v.map_columns


def table_rows(files: DataFrame, keep_case: bool = True, source_type: str = "csv") -> DataFrame:
    """Rows of delimited files: path, row (from 2, the header being 1), cells (map of header to value), fields (map of
    canonical field to value), refs (map of canonical field to its cell, `row:N column:header`), error (why a file gives no rows).
    Without `keep_case` headers are trimmed and in lower case. Files over many tasks: see splits."""

    def read(content: bytes):
        rows = list(units.csv_rows(io.BytesIO(content)))
        header = next((r for r in rows if r), [])
        if len(header) < 2:
            raise ValueError("fewer than two columns")
        named = header if keep_case else [h.strip().lower() for h in header]
        fields = map_columns(named, source_type)
        number = 1
        for row in rows[rows.index(header) + 1 :]:
            number += bool(row)
            cells = dict(zip(named, row, strict=False))
            found = {f: c for f, c in fields.items() if cells.get(c)}
            if row:
                yield number, cells, {f: cells[c] for f, c in found.items()}, {f: f"row:{number} column:{c}" for f, c in found.items()}

    schema = "row int, cells map<string,string>, fields map<string,string>, refs map<string,string>"
    return _each(files, read, schema, ["row", "cells", "fields", "refs"])


def emails(files: DataFrame) -> DataFrame:
    """path, headers (map), body (text/plain parts), attachments (names, not read) and error of RFC 822 messages."""

    def read(content: bytes):
        yield units.mail(content)

    return _each(files, read, "headers map<string,string>, body string, attachments array<string>", ["headers", "body", "attachments"])


def email_facts(mails: DataFrame) -> DataFrame:
    """path, sender, receiver, at and email_addresses of mails (see emails): what the headers state goes before what the text reads
    like, and the Message-ID, which looks like an address, is not searched."""
    from ..functions.identifiers import find_email_addresses
    from ..functions.moments import find_person_roles, find_timestamp

    head = lambda h: F.nullif(F.trim(F.try_element_at("headers", F.lit(h))), F.lit(""))
    said = lambda role: F.get(F.filter(find_person_roles(F.col("body")), lambda x: x["role"] == role), F.lit(0))["name"]
    searched = F.concat_ws("\n", *(head(h) for h in v.MAIL_HEADERS if h != "Message-ID"), "body")
    return mails.select(
        "path", F.coalesce(head("From"), said("sender")).alias("sender"), F.coalesce(head("To"), said("receiver")).alias("receiver"),
        F.coalesce(find_timestamp(head("Date"))["at"], find_timestamp(F.col("body"))["at"]).alias("at"), find_email_addresses(searched).alias("email_addresses"),
    )


def table_type(header: Column) -> Column:
    """Source type by header names, trimmed and in lower case: call data before call logs (unless money is named) before bank
    records."""
    has = lambda marks: F.arrays_overlap(header, F.array(*map(F.lit, marks)))
    call = has(v.CALL_MARKERS) & ~has(v.MONEY_MARKERS)
    return F.when(has(v.CDR_MARKERS), "cdr").when(call, "call_log").when(has(v.BANK_MARKERS), "bank_record").otherwise("csv")


def text_type(text: Column) -> Column:
    """chat_export, email or document by the first 8192 characters: a quarter of the first 40 lines (two at least) open chat
    messages; or one of the first 20 starts with a mail header."""
    bare = F.transform(F.split(F.substring(text, 1, 8192), "\r?\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    head = F.slice(F.filter(bare, lambda x: x != ""), 1, 40)
    chats = F.size(F.filter(head, lambda x: x.rlike(v.CHAT_OPENS)))
    mails = F.exists(F.slice(head, 1, 20), lambda x: F.lower(x).rlike("^(?:" + "|".join(v.MAIL_OPENS) + ")"))
    return F.when(chats >= F.greatest(F.lit(2), F.floor(F.size(head) / 4)), "chat_export").when(mails, "email").otherwise("document")


def detect_type(extension: Column, category: Column, header: Column, text: Column) -> Column:
    """struct<source_type, basis> of a file by extension, declared category, header names (of tables, trimmed and in lower case) and text: content and
    category together, as far as each says something."""
    hints = F.create_map(*(F.lit(x) for kv in v.CATEGORY_HINTS.items() for x in kv))
    hint = F.try_element_at(hints, category)
    kind = lambda t, basis: F.struct(t.alias("source_type"), (F.lit(basis) if isinstance(basis, str) else basis).alias("basis"))
    both = F.when(hint.isNotNull(), "content+category").otherwise("content")
    return (
        F.when(extension.isin("png", "jpg", "jpeg"), kind(F.when(hint == "screenshot", hint).otherwise("image"), both))
        .when(extension == "pdf", F.when(hint.isin(*v.REPORT_TYPES), kind(hint, "content+category")).otherwise(kind(F.lit("pdf"), "content")))
        .when(extension == "eml", kind(F.lit("email"), "content"))
        .when(extension == "csv", kind(F.when(hint.isin("bank_record", "call_log", "cdr"), hint).otherwise(table_type(header)), "content+headers"))
        .when(extension == "xlsx", kind(F.coalesce(hint, F.lit("spreadsheet")), both))
        .when((extension == "txt") & hint.isin(*v.REPORT_TYPES, "chat_export", "email"), kind(hint, "category"))
        .when(extension == "txt", kind(text_type(text), "content"))
        .otherwise(kind(F.coalesce(hint, F.lit("unknown")), "fallback"))
    )


def parser_of(extension: Column) -> Column:
    """The reader of a file by its extension; null where there is none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in v.PARSERS.items() for x in kv)), F.lower(extension))
