"""A file's observations, by its detected type: rows of tables and spreadsheets, chat messages, mails, lines of documents.

Every reader here streams one file and yields units with their place in it. A file that can't be read gives one row with an
error. Readers know nothing of Spark; `evidence` (a data source) and `of_files` (a table of contents) run them in tasks.
"""

from __future__ import annotations

import csv
import datetime as dt
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

from . import vocabulary as v

SCHEMA = (
    "path string, source_type string, basis string, unit_key string, kind string, text string, line long, row long, message long, "
    "cells map<string,string>, fields map<string,string>, error string"
)
HEAD = 1 << 16  # bytes read to detect a type
MOST_FIELD = 1 << 27  # characters of a cell
MOST_XML = 1 << 30  # bytes that a part of a spreadsheet may unpack to
WORKBOOK = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(45, 48)}  # fixed values: the built-in number formats of dates and times


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def table_type(header: list[str]) -> str:
    names = {h.strip().lower() for h in header}
    if names & {*v.CDR_MARKERS}:
        return "cdr"
    if names & {*v.CALL_MARKERS} and not names & {*v.MONEY_MARKERS}:
        return "call_log"
    return "bank_record" if names & {*v.BANK_MARKERS} else "csv"


def text_type(head: str) -> str:
    lines = [x.strip() for x in head[:8192].splitlines() if x.strip()]
    some = lines[:40]
    if some and sum(bool(re.match(v.CHAT_OPENS, x)) for x in some) >= max(2, len(some) // 4):
        return "chat_export"
    return "email" if any(x.lower().startswith(v.MAIL_OPENS) for x in lines[:20]) else "document"


def detect(path: str, head: bytes, category: str | None = None) -> tuple[str, str]:
    """(source type, basis) of a file by its extension, first bytes and declared category."""
    ext, hint = extension_of(path), v.CATEGORY_HINTS.get(category or "")
    both = "content+category" if hint else "content"
    if ext in ("png", "jpg", "jpeg"):
        return ("screenshot" if hint == "screenshot" else "image"), both
    if ext == "pdf":
        return (hint, "content+category") if hint in v.REPORT_TYPES else ("pdf", "content")
    if ext == "eml":
        return "email", "content"
    if ext == "csv":
        if hint in ("bank_record", *v.CALL_TYPES):
            return hint, "content+headers"
        first = next(csv.reader(io.StringIO(head.decode("utf-8-sig", errors="replace"), newline="")), [])
        return table_type(first), "content+headers"
    if ext == "xlsx":
        return hint or "spreadsheet", both
    if ext == "txt":
        if hint in (*v.REPORT_TYPES, "chat_export", "email"):
            return hint, "category"
        return text_type(head.decode("utf-8", errors="replace")), "content"
    return hint or "unknown", "fallback"


# --- tables


def sniff(sample: str):
    """The dialect of a table by its first characters: one of four separators, else commas."""
    try:
        return csv.Sniffer().sniff(sample, ",;\t|") if sample.strip() else csv.excel
    except csv.Error:
        return csv.excel


def csv_rows(stream: IO[bytes]) -> Iterator[list[str]]:
    text = io.TextIOWrapper(stream, "utf-8-sig", newline="")
    dialect = sniff(text.read(4096))
    text.seek(0)
    csv.field_size_limit(MOST_FIELD)
    yield from csv.reader(text, dialect)


def _parts(book: zipfile.ZipFile, name: str) -> IO[bytes]:
    if book.getinfo(name).file_size > MOST_XML:
        raise ValueError(f"{name} unpacks to more than {MOST_XML} bytes")
    return book.open(name)


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, node in ElementTree.iterparse(_parts(book, "xl/sharedStrings.xml")):
        if node.tag == f"{WORKBOOK}si":
            out.append(_rich(node))
            node.clear()
    return out


def _rich(node) -> str:
    """The text of a string item: its own, or its runs' without phonetic readings."""
    return "".join(t.text or "" for t in [*node.findall(f"{WORKBOOK}t"), *node.findall(f"{WORKBOOK}r/{WORKBOOK}t")])


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.parse(_parts(book, "xl/styles.xml")).getroot()
    own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in root.iter(f"{WORKBOOK}numFmt")}
    dated = lambda i: i in DATE_FORMATS or bool(re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", own.get(i, "").lower())))
    styles = root.find(f"{WORKBOOK}cellXfs")
    return {i for i, x in enumerate(styles if styles is not None else ()) if dated(int(x.get("numFmtId", 0)))}


def _first_sheet(book: zipfile.ZipFile) -> tuple[str, bool]:
    """(the part that holds the first sheet, whether days count from 1904)."""
    root = ElementTree.parse(_parts(book, "xl/workbook.xml")).getroot()
    sheet, setting = root.find(f"{WORKBOOK}sheets/{WORKBOOK}sheet"), root.find(f"{WORKBOOK}workbookPr")
    links = ElementTree.parse(_parts(book, "xl/_rels/workbook.xml.rels")).getroot()
    target = next(x.get("Target") for x in links if x.get("Id") == sheet.get(LINK))
    late = setting is not None and setting.get("date1904") in ("1", "true")
    return (target.lstrip("/") if target.startswith("/") else f"xl/{target}"), late


def _value(cell, shared: list[str], dates: set[int], late: bool) -> str:
    kind, raw = cell.get("t", "n"), cell.find(f"{WORKBOOK}v")
    if kind == "inlineStr":
        node = cell.find(f"{WORKBOOK}is")
        return _rich(node) if node is not None else ""
    if raw is None or raw.text is None or kind == "e":
        return ""
    if kind == "s":
        return shared[int(raw.text)]
    if kind == "b":
        return str(raw.text == "1")
    if kind in ("str", "d"):
        return raw.text
    if int(cell.get("s", 0)) in dates:
        days = float(raw.text)
        return str(dt.datetime(1904, 1, 1) + dt.timedelta(days=days) if late else dt.datetime(1899, 12, 30) + dt.timedelta(days=days))
    return str(float(raw.text) if re.search(r"[.eE]", raw.text) else int(raw.text))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def sheet_rows(stream: IO[bytes]) -> Iterator[list[str]]:
    """The rows of the first sheet, cells as text: whole numbers without a point, dates as `2024-03-12 00:00:00`, errors empty."""
    with zipfile.ZipFile(stream) as book:
        shared, dates = _shared(book), _date_styles(book)
        part, late = _first_sheet(book)
        at = 0
        for _, node in ElementTree.iterparse(_parts(book, part)):
            if node.tag != f"{WORKBOOK}row":
                continue
            number, row = int(node.get("r", at + 1)), []
            for i, c in enumerate(node.findall(f"{WORKBOOK}c")):
                place = _column(c.get("r")) if c.get("r") else i
                row += [""] * (place - len(row)) + [_value(c, shared, dates, late)]
            for _ in range(at + 1, number):
                yield []
            at = number
            yield row
            node.clear()


def named(header: list[str]) -> list[str]:
    """A spreadsheet's headers: empty ones by their place, repeated ones with a number."""
    out, seen = [], {}
    for i, h in enumerate(header):
        h = h or f"Unnamed: {i}"
        seen[h] = seen.get(h, -1) + 1
        out.append(f"{h}.{seen[h]}" if seen[h] else h)
    return out


def table_units(rows: Iterator[list[str]], source_type: str, sheet: bool = False) -> Iterator[dict]:
    header = next(rows, [])
    while not header and not sheet:  # leading blank lines of a delimited file
        header = next(rows, None)
        if header is None:
            return
    header = named(header) if sheet else header
    fields = v.map_columns(header, source_type)
    number = 1
    for row in rows:
        if not row and not sheet:
            continue  # blank lines of a delimited file aren't rows
        number += 1
        cells = {h: x.strip() for h, x in zip(header, row, strict=False) if h and x.strip()}
        if cells:
            yield {
                "unit_key": f"row:{number}", "kind": "table_row", "row": number, "cells": cells, "text": " | ".join(f"{h}: {x}" for h, x in cells.items()),
                "fields": {f: cells[h] for f, h in fields.items() if h in cells},
            }


# --- texts


def lines_of(stream: IO[bytes]) -> Iterator[str]:
    """The lines of a text whose bad bytes are replaced, one physical line at a time."""
    for raw in io.TextIOWrapper(stream, "utf-8", errors="replace", newline="\n"):
        yield from raw.splitlines()


def chat_units(lines: Iterator[str]) -> Iterator[dict]:
    """Messages and notices. A line that opens neither goes on with the message above; after a notice, or before any, it is dropped."""
    now, index = None, -1
    for number, line in enumerate(lines, 1):
        bare = line.strip()
        if not bare:
            continue
        message = re.match(v.CHAT_MESSAGE, bare)
        notice = None if message else re.match(v.CHAT_NOTICE, bare)
        if not message and not notice:
            if now and now["kind"] == "chat_message":
                now["text"] += f"\n{line}"
            continue
        if now:
            yield now
        index += 1
        found = message or notice
        fields = {"event_time": found[1].strip()} | ({"sender": message[2].strip()} if message else {})
        now = {"unit_key": f"message:{index}", "kind": "chat_message" if message else "chat_system_notice", "text": found[found.re.groups], "line": number, "message": index, "fields": fields}
    if now:
        yield now


def line_units(lines: Iterator[str]) -> Iterator[dict]:
    for number, line in enumerate(lines, 1):
        if len(bare := line.strip()) >= 3:
            yield {"unit_key": f"line:{number}", "kind": "paragraph", "text": bare, "line": number}


def _decoded(part) -> str:
    """A part's text in its declared character set; in UTF-8 where no such set is known."""
    payload = part.get_payload(decode=True)
    if payload is None:
        return str(part.get_payload())
    try:
        return payload.decode(part.get_content_charset() or "utf-8", errors="replace")
    except LookupError:
        return payload.decode("utf-8", errors="replace")


def mail(content: bytes) -> tuple[dict[str, str], str, list[str]]:
    """(headers, text of the plain parts that aren't attached, names of attachments) of an RFC 822 message."""
    m = email.message_from_bytes(content, policy=email.policy.default)
    if not m.is_multipart():
        body = _decoded(m)
    else:
        plain = (p for p in m.walk() if p.get_content_type() == "text/plain" and p.get_content_disposition() != "attachment")
        body = "\n".join(filter(None, map(_decoded, plain)))
    return {h: str(m[h]) for h in v.MAIL_HEADERS if m[h]}, body, [p.get_filename() or "" for p in m.walk() if p.get_content_disposition() == "attachment"]


def mail_units(content: bytes) -> Iterator[dict]:
    headers, body, attached = mail(content)
    fields = {f: headers[h] for f, h in (("sender", "From"), ("receiver", "To"), ("event_time", "Date")) if h in headers}
    text = "\n".join([*(f"{h}: {x}" for h, x in headers.items()), "", body])
    yield {"unit_key": "email:0", "kind": "email", "text": text, "cells": headers | ({"attachments": ", ".join(attached)} if attached else {}), "fields": fields}


# --- one file


def units_of(path: str, stream: IO[bytes], category: str | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA for a file. Types without a reader here (pictures, PDF, unknown ones) and files that can't be read give one
    row with an error; what was read before a fault stays."""
    source_type = basis = None

    def row(unit: dict, error: str | None = None) -> tuple:
        get = unit.get
        return (path, source_type, basis, get("unit_key"), get("kind"), get("text"), get("line"), get("row"), get("message"), get("cells"), get("fields"), error)

    try:
        head = stream.read(HEAD)
        source_type, basis = detect(path, head, category)
        stream.seek(0)
        ext, n = extension_of(path), 0
        if source_type == "chat_export":
            units = chat_units(lines_of(stream))
        elif source_type == "email":
            units = mail_units(stream.read())
        elif ext in ("csv", "xlsx") and source_type in v.TABLE_TYPES:
            units = table_units(sheet_rows(stream) if ext == "xlsx" else csv_rows(stream), source_type, ext == "xlsx")
        elif ext in ("png", "jpg", "jpeg", "pdf") or source_type == "unknown":
            raise ValueError(f"no reader of {source_type} files here")
        else:
            units = line_units(lines_of(stream))
        for unit in units:
            n += 1
            yield row(unit)
        if not n:
            yield row({}, "no units in it")
    except Exception as e:  # one bad file is a row and not the job's end
        yield row({}, f"{type(e).__name__}: {e}"[:500])
