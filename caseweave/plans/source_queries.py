"""Files of many sorts, their types, columns and units. The files are drawn from the tables: their number grows with them."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import facts, upkeep
from ..operators.lineage import shared_path
from ..sources import evidence, files, sinks, splits, store
from ..sources import vocabulary as v
from . import standins as s
from .standins import query

PER_FILE = 64

# --- headers and texts


CDR = "['a-party', 'a party', 'b-party', 'b party', 'calling number', 'called number', 'originating number', 'terminating number', 'msisdn_a', 'msisdn_b', 'a_number', 'b_number']"
CALL = "['duration', 'call_type', 'call type', 'caller', 'callee', 'number', 'direction']"
BANK = "['amount', 'credit', 'debit', 'balance', 'utr', 'reference', 'transaction', 'narration', 'particulars']"


@query("detect_headers", f"""
WITH m AS (SELECT {CDR} AS cdr, {CALL} AS call, {BANK} AS bank, list_concat(list_concat({CDR}, {CALL}), list_concat({BANK}, ['date', 'imei', 'location', 'aparty'])) AS everything),
h AS (SELECT o_orderkey, m.*, [everything[o_orderkey % 32 + 1], everything[(o_orderkey // 32) % 32 + 1]] AS header FROM orders, m)
SELECT o_orderkey, array_to_string(header, ',') AS header, CASE WHEN list_has_any(header, cdr) THEN 'cdr' WHEN list_has_any(header, call) AND NOT list_has_any(header, ['amount', 'credit', 'debit', 'balance']) THEN 'call_log'
  WHEN list_has_any(header, bank) THEN 'bank_record' ELSE 'csv' END AS source_type FROM h
""")  # fmt: skip
def detect_headers(spark, sf):
    """Every pair of the header names that mark a table's type, and of some that mark none."""
    k, names = F.col("o_orderkey"), F.array(*map(F.lit, (*v.CDR_MARKERS, *v.CALL_MARKERS, *v.BANK_MARKERS, "date", "imei", "location", "aparty")))
    pair = F.array(F.get(names, (k % 32).cast("int")), F.get(names, (F.floor(k / 32) % 32).cast("int")))
    o = s.read(spark, sf, "orders").select("o_orderkey", pair.alias("h"))
    return o.select("o_orderkey", F.array_join("h", ",").alias("header"), files.table_type(F.col("h")).alias("source_type"))


_STAMPS = ("12/03/2024, 21:16 - ", "[12-03-24, 9:16 pm] ", "1/2/24 9:05:07 – ", "12-3-2024, 9:16 A.M. - ", "2024-03-12 21:16 - ", "12.03.2024, 21:16 - ")


@query("detect_text_type", """
SELECT event_id, CASE WHEN event_id % 6 < 4 AND chats >= greatest(2, (chats + others) // 4) THEN 'chat_export' WHEN others > 0 AND event_id % 7 = 0 THEN 'email' ELSE 'document' END AS kind
FROM (SELECT event_id, user_id % 7 AS chats, event_id % 31 AS others FROM events)
""")  # fmt: skip
def detect_text_type(spark, sf):
    """Texts of some lines that open chat messages, in four forms that count and two that don't, and some that don't, among them
    for some a mail header."""
    k = F.col("event_id")
    stamp = F.get(F.array(*map(F.lit, _STAMPS)), (k % 6).cast("int"))
    chat = F.concat(stamp, F.lit("Asha Rao: hello\n"))
    plain = F.when(k % 7 == 0, "  Subject: hello\n").otherwise("plain words\n")
    text = F.concat(F.repeat(chat, (F.col("user_id") % 7).cast("int")), F.repeat(plain, (k % 31).cast("int")))
    return s.read(spark, sf, "events").select("event_id", files.text_type(text).alias("kind"))


_ALIASES = [(kind, field, name) for kind, table in (("bank_record", v.BANK_COLUMNS), ("cdr", v.CALL_COLUMNS)) for field, names in table.items() for name in names]
# The aliases again, as the SQL states them.
_ALIAS_SQL = """[
  ['bank_record', 'amount', 'amount'], ['bank_record', 'amount', 'txn amount'], ['bank_record', 'amount', 'transaction amount'], ['bank_record', 'amount', 'value'], ['bank_record', 'amount', 'credit'],
  ['bank_record', 'amount', 'debit'], ['bank_record', 'transaction_reference', 'utr'], ['bank_record', 'transaction_reference', 'reference'], ['bank_record', 'transaction_reference', 'reference id'],
  ['bank_record', 'transaction_reference', 'reference_no'], ['bank_record', 'transaction_reference', 'transaction id'], ['bank_record', 'transaction_reference', 'txn id'], ['bank_record', 'transaction_reference', 'rrn'],
  ['bank_record', 'event_time', 'date'], ['bank_record', 'event_time', 'timestamp'], ['bank_record', 'event_time', 'txn date'], ['bank_record', 'event_time', 'transaction date'], ['bank_record', 'event_time', 'value date'],
  ['bank_record', 'event_time', 'time'], ['bank_record', 'sender', 'sender'], ['bank_record', 'sender', 'from'], ['bank_record', 'sender', 'payer'], ['bank_record', 'sender', 'remitter'], ['bank_record', 'sender', 'debit account'],
  ['bank_record', 'receiver', 'receiver'], ['bank_record', 'receiver', 'to'], ['bank_record', 'receiver', 'beneficiary'], ['bank_record', 'receiver', 'payee'], ['bank_record', 'receiver', 'credit account'],
  ['bank_record', 'account_identifiers', 'account'], ['bank_record', 'account_identifiers', 'account no'], ['bank_record', 'account_identifiers', 'account number'], ['bank_record', 'account_identifiers', 'a/c'],
  ['bank_record', 'account_identifiers', 'ifsc'], ['bank_record', 'account_identifiers', 'upi'], ['bank_record', 'account_identifiers', 'upi id'], ['bank_record', 'narration', 'narration'], ['bank_record', 'narration', 'particulars'],
  ['bank_record', 'narration', 'description'], ['bank_record', 'narration', 'remarks'], ['bank_record', 'narration', 'purpose'],
  ['cdr', 'sender', 'a-party'], ['cdr', 'sender', 'a party'], ['cdr', 'sender', 'aparty'], ['cdr', 'sender', 'caller'], ['cdr', 'sender', 'calling number'], ['cdr', 'sender', 'calling party'], ['cdr', 'sender', 'from'],
  ['cdr', 'sender', 'originating number'], ['cdr', 'sender', 'msisdn_a'], ['cdr', 'sender', 'a_number'], ['cdr', 'receiver', 'b-party'], ['cdr', 'receiver', 'b party'], ['cdr', 'receiver', 'bparty'], ['cdr', 'receiver', 'callee'],
  ['cdr', 'receiver', 'called number'], ['cdr', 'receiver', 'called party'], ['cdr', 'receiver', 'to'], ['cdr', 'receiver', 'terminating number'], ['cdr', 'receiver', 'msisdn_b'], ['cdr', 'receiver', 'b_number'],
  ['cdr', 'phone_numbers', 'number'], ['cdr', 'phone_numbers', 'phone'], ['cdr', 'phone_numbers', 'contact'], ['cdr', 'phone_numbers', 'msisdn'], ['cdr', 'event_time', 'date'], ['cdr', 'event_time', 'time'],
  ['cdr', 'event_time', 'timestamp'], ['cdr', 'event_time', 'call date'], ['cdr', 'event_time', 'start time'], ['cdr', 'event_time', 'call start'], ['cdr', 'message_direction', 'direction'], ['cdr', 'message_direction', 'call type'],
  ['cdr', 'message_direction', 'call_type'], ['cdr', 'message_direction', 'type'], ['cdr', 'duration', 'duration'], ['cdr', 'duration', 'call duration'], ['cdr', 'duration', 'seconds'], ['cdr', 'duration', 'duration_seconds'],
  ['cdr', 'device_identifier', 'imei'], ['cdr', 'device_identifier', 'device'], ['cdr', 'device_identifier', 'device id'], ['cdr', 'device_identifier', 'imsi'], ['cdr', 'cell_site', 'cell id'], ['cdr', 'cell_site', 'cell_id'],
  ['cdr', 'cell_site', 'cell'], ['cdr', 'cell_site', 'tower'], ['cdr', 'cell_site', 'tower id'], ['cdr', 'cell_site', 'site id'], ['cdr', 'cell_site', 'lac'], ['cdr', 'cell_site', 'cgi']]"""  # fmt: skip


@query("map_columns", f"""
WITH a AS (SELECT {_ALIAS_SQL} AS x)
SELECT c_custkey, x[(c_custkey % len(x) + 1)::INT][2] AS field, 'v' || c_custkey AS value FROM customer, a
""")  # fmt: skip
def map_columns(spark, sf):
    """Each alias of both kinds of table, written in capitals with other separators, names its field."""
    k, n = F.col("c_custkey"), len(_ALIASES)
    pick = lambda i: F.get(F.array(*(F.lit(a[i]) for a in _ALIASES)), (k % n).cast("int"))
    header = F.regexp_replace(F.upper(pick(2)), "[ _/-]", F.when(k % 2 == 0, ".").otherwise(" "))
    made = facts.spread(s.read(spark, sf, "customer")).select(
        F.concat(k.cast("string"), F.lit(".csv")).alias("path"), F.concat(F.lit("Unheard,"), header, F.lit("\n1,v"), k.cast("string"), F.lit("\n")).cast("binary").alias("content"), pick(0).alias("category")
    )
    kind = F.when(F.col("category") == "cdr", "cdr").otherwise("bank_statement")
    got = evidence.of_files(made.withColumn("category", kind)).select("path", F.explode("fields").alias("field", "value"))
    return got.select(F.regexp_extract("path", r"\d+", 0).cast("long").alias("c_custkey"), "field", "value")


# --- whole files


def _workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """path, content: a workbook of each file's rows, numbers as numbers and texts both shared and inline."""
    for pdf in batches:
        out = []
        for path, rows in zip(pdf["path"], pdf["rows"], strict=True):
            shared: dict[str, int] = {}
            lines = []
            for i, row in enumerate(rows):
                cells = []
                for j, x in enumerate(row):
                    at = f"{chr(65 + j)}{i + 1}"
                    if i and j == 1:
                        cells.append(f'<c r="{at}"><v>{x}</v></c>')
                    elif x and (i + j) % 2:
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(x)}</t></is></c>')
                    elif x:
                        cells.append(f'<c r="{at}" t="s"><v>{shared.setdefault(x, len(shared))}</v></c>')
                lines.append(f'<row r="{i + 1}">{"".join(cells)}</row>')
            main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as book:
                book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
                book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
                book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{escape(x)}</t></si>" for x in shared)}</sst>')
                book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
            out.append((path, raw.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


BANK_HEADER = ("Txn Date", "Txn Amount", "Remitter", "Payee", "UPI ID", "Particulars")
_KINDS = ("csv", "csv", "txt", "eml", "xlsx", "txt", "bin")


def mixed_files(spark, sf) -> DataFrame:
    """A file for every 64 customers, of seven sorts in turn: a bank table, call data, a chat, a mail, a workbook, a note, a
    file of no known sort. path, content."""
    k = F.col("c_custkey").cast("string")
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    amount, said = F.format_string("%.2f", "c_acctbal"), F.concat(F.lit('for "'), F.col("c_mktsegment"), F.lit('"\nof '), F.col("c_name"))
    cells = F.array(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 300).cast("int")), "yyyy-MM-dd"), amount, F.col("c_name"), F.concat(F.lit("S"), k), F.concat(F.lit("u"), k, F.lit("@okbank")), said)
    f = F.floor(F.col("c_custkey") / PER_FILE)
    kind = (f % len(_KINDS)).cast("int")
    bank = F.concat(F.array_join(F.slice(cells, 1, 5), ","), F.lit(","), q(said), F.lit("\n"))
    call = F.concat(F.concat(F.lit("C"), k), F.lit(","), F.lit("B"), k, F.lit(",12/03/2024 21:16,OUT,T-"), k, F.lit("\n"))
    chat = F.concat(F.lit("12-03-2024, 21:16 - "), F.col("c_name"), F.lit(": sent "), amount, F.when(F.col("c_custkey") % 3 == 0, "\nand more").otherwise(""), F.lit("\n"))
    mail = F.concat(F.col("c_name"), F.lit(" wrote\n"))
    line = F.when(kind == 0, bank).when(kind == 1, call).when(kind == 2, chat).when(kind.isin(3, 5), mail).otherwise(F.lit("x\n"))
    c = s.read(spark, sf, "customer").select(f.alias("f"), "c_custkey", kind.alias("kind"), line.alias("line"), cells.alias("cells"))
    per = c.groupBy("f", "kind").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "line", "cells"))).alias("s"))
    head = (
        F.when(F.col("kind") == 0, ",".join(BANK_HEADER) + "\n").when(F.col("kind") == 1, "Originating number,Terminating number,Call date,Call type,Cell ID\n")
        .when(F.col("kind") == 3, "From: a@x.io\nTo: b@x.io\nDate: Tue, 12 Mar 2024 21:15:00 +0530\nSubject: Hi\nContent-Type: text/plain; charset=unheard-of\n\n").otherwise("")
    )
    body = F.array_join(F.transform("s", lambda x: x["line"]), "")
    ends = F.get(F.array(*map(F.lit, _KINDS)), F.col("kind"))
    made = per.select(F.concat(F.lit("f"), F.col("f").cast("string"), F.lit("."), ends).alias("path"), F.concat(head, body).cast("binary").alias("content"), "kind", "s")
    rows = F.concat(F.array(F.array(*map(F.lit, BANK_HEADER))), F.transform("s", lambda x: x["cells"]))
    books = made.where("kind = 4").select("path", rows.alias("rows")).mapInPandas(_workbooks, "path string, content binary")
    return made.where("kind <> 4").select("path", "content").unionByName(books)


CUSTOMER_FILES_SQL = f"""c AS (
  SELECT *, c_custkey // {PER_FILE} AS f, (c_custkey // {PER_FILE}) % 7 AS kind, row_number() OVER (PARTITION BY c_custkey // {PER_FILE} ORDER BY c_custkey) AS n,
    printf('%.2f', c_acctbal) AS amount, strftime(DATE '2024-01-01' + (c_custkey % 300)::INT, '%Y-%m-%d') AS day,
    'for "' || c_mktsegment || '"' || chr(10) || 'of ' || c_name AS said FROM customer)"""


@query("dispatch_type", f"""
WITH {CUSTOMER_FILES_SQL}
SELECT 'f' || f || CASE kind WHEN 0 THEN '.csv' ELSE '.xlsx' END AS path, CASE kind WHEN 0 THEN 'bank_record' ELSE 'spreadsheet' END AS source_type, 'row:' || (n + 1) AS unit_key,
  concat_ws(';', 'account_identifiers=u' || c_custkey || '@okbank', 'amount=' || CASE kind WHEN 0 THEN amount ELSE CASE WHEN c_acctbal = trunc(c_acctbal) THEN c_acctbal::BIGINT || '.0' ELSE c_acctbal::VARCHAR END END, 'event_time=' || day, 'narration=' || said, 'receiver=S' || c_custkey, 'sender=' || c_name) AS fields,
  NULL AS text, NULL AS error FROM c WHERE kind IN (0, 4)
UNION ALL SELECT 'f' || f || '.csv', 'cdr', 'row:' || (n + 1), concat_ws(';', 'cell_site=T-' || c_custkey, 'event_time=12/03/2024 21:16', 'message_direction=OUT', 'receiver=B' || c_custkey, 'sender=C' || c_custkey), NULL, NULL FROM c WHERE kind = 1
UNION ALL SELECT 'f' || f || '.txt', 'chat_export', 'message:' || (n - 1), 'event_time=12-03-2024, 21:16;sender=' || c_name, 'sent ' || amount || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || 'and more' ELSE '' END, NULL FROM c WHERE kind = 2
UNION ALL SELECT 'f' || f || '.eml', 'email', 'email:0', 'event_time=Tue, 12 Mar 2024 21:15:00 +0530;receiver=b@x.io;sender=a@x.io',
  'From: a@x.io' || chr(10) || 'To: b@x.io' || chr(10) || 'Date: Tue, 12 Mar 2024 21:15:00 +0530' || chr(10) || 'Subject: Hi' || chr(10) || chr(10) || string_agg(c_name || ' wrote' || chr(10), '' ORDER BY c_custkey), NULL FROM c WHERE kind = 3 GROUP BY f
UNION ALL SELECT 'f' || f || '.txt', 'document', 'line:' || n, NULL, c_name || ' wrote', NULL FROM c WHERE kind = 5
UNION ALL SELECT DISTINCT 'f' || f || '.bin', 'unknown', NULL, NULL, NULL, 'ValueError: no reader of unknown files here' FROM c WHERE kind = 6
""")  # fmt: skip
def dispatch_type(spark, sf):
    """The units of files of seven sorts, each by the reader of its detected type."""
    got = evidence.of_files(mixed_files(spark, sf))
    pairs = F.array_sort(F.transform(F.map_entries("fields"), lambda x: F.concat(x["key"], F.lit("="), x["value"])))
    fields = F.when(F.size("fields") > 0, F.array_join(pairs, ";"))
    table = F.col("kind") == "table_row"
    return got.select("path", "source_type", "unit_key", fields.alias("fields"), F.when(~table, F.col("text")).alias("text"), "error")


@query("src_csv_grounded", f"""
WITH {CUSTOMER_FILES_SQL}, b AS (SELECT 'f' || f || '.csv row:' || (n + 1) AS unit, * FROM c WHERE kind = 0)
SELECT unit, 'amount' AS kind, amount AS value, 0.98::DOUBLE AS confidence FROM b WHERE c_acctbal >= 100
UNION ALL SELECT unit, 'event_time', day || 'T00:00:00', 0.98 FROM b UNION ALL SELECT unit, 'event_time_precision', 'date_only', 0.98 FROM b
UNION ALL SELECT unit, 'sender', c_name, 0.97 FROM b UNION ALL SELECT unit, 'receiver', 'S' || c_custkey, 0.97 FROM b
UNION ALL SELECT unit, 'account_identifiers', 'u' || c_custkey || '@okbank', 0.96 FROM b UNION ALL SELECT unit, 'narration', said, 0.99 FROM b
""")  # fmt: skip
def src_csv_grounded(spark, sf):
    """What the cells of bank tables state, with the confidence of their columns; amounts below 100 without a currency are no money."""
    units = evidence.of_files(mixed_files(spark, sf)).where("source_type = 'bank_record'")
    cells = units.select(F.concat_ws(" ", "path", "unit_key").alias("unit_id"), F.explode("fields").alias("field", "raw"))
    got = facts.cell_facts(cells).withColumnRenamed("unit_id", "unit")
    return got.where("kind <> 'amount' OR cast(value AS double) >= 100")


@query("src_csv", """
SELECT o_orderkey, o_totalprice AS amount, 'C' || o_custkey AS sender, 'S' || o_orderkey AS receiver, o_orderpriority || ', "said"' || chr(10) || chr(10) || o_orderstatus AS narration, 'bank_record' AS source_type FROM orders
""")  # fmt: skip
def src_csv(spark, sf):
    """Orders written as delimited files with quotes and line ends in cells, read again in ranges."""
    said = F.concat(F.col("o_orderpriority"), F.lit(', "said"\n\n'), F.col("o_orderstatus"))
    o = s.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("Txn ID"), F.col("o_totalprice").alias("Txn Amount"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("Remitter"),
        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("Payee"), said.alias("Particulars"),
    )
    path = shared_path(spark, "tables")
    o.write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)
    x = lambda f: F.col("fields")[f]
    return splits.table_rows(spark, path).select(
        x("transaction_reference").cast("long").alias("o_orderkey"), x("amount").cast("double").alias("amount"), x("sender").alias("sender"), x("receiver").alias("receiver"), x("narration").alias("narration"), "source_type"
    )


@query("src_chat_export", """
WITH t AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(coalesce(text, ''), '[\\x0B\\x0C\\r\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]', ' ', 'g'), chr(10)), lambda l, i: i = 1 OR trim(l) <> '') AS l FROM conversations)
SELECT 'P' || conv_id || ' ' || coalesce(turn, 0) AS sender, '12-3-2024, 10:15 am' AS stamp, regexp_replace(l[1], '^ | +$', '', 'g') || CASE WHEN len(l) > 1 THEN chr(10) || array_to_string(l[2:], chr(10)) ELSE '' END AS body FROM t
""")  # fmt: skip
def src_chat_export(spark, sf):
    """Conversations written as chat exports and read again in ranges: lines that open no message go on with the one above."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x0B\\x0C\\r\\x1C-\\x1E\\x{85}\\x{2028}\\x{2029}]", " ")
    c = s.read(spark, sf, "conversations").select(F.concat(F.lit("12-3-2024, 10:15 am - P"), F.col("conv_id").cast("string"), F.lit(" "), F.coalesce("turn", F.lit(0)).cast("string"), F.lit(": "), text).alias("value"))
    path = shared_path(spark, "chats")
    c.write.text(path)
    return splits.chat_messages(spark, path).select("sender", "stamp", "body")


@query("src_lines_split", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) >= 3 GROUP BY 1")
def src_lines_split(spark, sf):
    """Lines of documents written as text files, told apart by a mark and counted again."""
    path = shared_path(spark, "texts")
    mark = F.concat(F.lit("\n@@"), F.col("doc_id").cast("string"), F.lit("@@"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.length(F.trim(x)) >= 3)
    s.read(spark, sf, "documents").select(F.array_join(F.transform(lines, lambda x: F.concat(x, mark)), "\n").alias("value")).where("value <> ''").write.text(path)
    got = splits.lines(spark, path, 3).select(F.regexp_extract("text", r"^@@(\d+)@@$", 1).alias("d")).where("d <> ''")
    return got.groupBy(F.col("d").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))


# --- tables kept by case


def _laid_out(spark, rows: DataFrame, name: str, key: str, buckets: int = 4) -> DataFrame:
    table = f"cw_{name}_{uuid.uuid4().hex}"
    store.create(spark, table, rows, shared_path(spark, name), key, buckets=buckets)
    store.replace(table, rows, key, buckets=buckets)
    return spark.table(table)


@query("table_scan", f"""
WITH {s.RELATIONS_SQL} SELECT id, case_id, relation_type, 'Subject ' || subject AS subject_name FROM rels WHERE case_id IN (3, 7)
""")  # fmt: skip
def table_scan(spark, sf):
    """Two cases' relations with their subjects' names, from tables partitioned by case and bucketed by the subject."""
    r = s.relations(spark, sf).withColumn("subject_node", store.node(F.col("case_id"), F.col("subject"))).select("id", "case_id", "relation_type", "subject", "subject_node")
    e = r.select("case_id", F.col("subject_node").alias("node"), F.concat(F.lit("Subject "), "subject").alias("display")).distinct()
    two = F.col("case_id").isin(3, 7)
    got = store.relation_ends(_laid_out(spark, r, "relations", "subject_node").where(two), _laid_out(spark, e, "entities", "node").where(two))
    return got.select("id", "case_id", "relation_type", "subject_name")


@query("upkeep_alerts", f"""
WITH {s.TRANSACTIONS_SQL}, g AS (SELECT case_id, epoch_us(at) - epoch_us(lag(at) OVER (PARTITION BY case_id ORDER BY at)) AS gap FROM (SELECT case_id, date_trunc('minute', at) AS at FROM txns))
SELECT case_id::VARCHAR AS case_id, 'HIGH_VALUE_TRANSFER' AS rule, count(*) AS n FROM txns WHERE round(amount, 2) >= 50000 GROUP BY 1
UNION ALL SELECT case_id::VARCHAR, 'REPEATED_RECIPIENT', count(*) FROM (SELECT case_id, receiver FROM txns WHERE round(amount, 2) >= 100 GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1
UNION ALL SELECT DISTINCT case_id::VARCHAR, 'RAPID_TRANSACTION_SEQUENCE', 1 FROM g WHERE gap <= 5400000000
""")  # fmt: skip
def upkeep_alerts(spark, sf):
    """The alerts of transactions that come as units in three batches, of which one comes twice."""
    t = s.transactions(spark, sf)
    file_ = F.floor(F.col("id") / 512)
    fields = F.create_map(
        F.lit("event_time"), F.date_format("at", "yyyy-MM-dd HH:mm"), F.lit("amount"), F.format_string("%.2f", "amount"), F.lit("sender"), F.concat(F.lit("C"), F.col("sender").cast("string")),
        F.lit("receiver"), F.col("receiver"),
    )
    units = t.select(
        F.concat_ws("/", F.lit("x"), F.col("case_id").cast("string"), file_.cast("string")).alias("path"), F.concat(F.lit("row:"), F.col("id").cast("string")).alias("unit_key"),
        F.lit("bank_record").alias("source_type"), F.lit("").alias("text"), fields.alias("fields"), F.lit(None).cast("string").alias("error"), (file_ % 3).alias("b"),
    )
    kept = upkeep.Upkeep(spark, shared_path(spark, "upkeep"), buckets=2)
    for b in (0, 1, 1, 2):
        kept.apply(units.where(F.col("b") == b), f"b{b}")
    return kept.table("alerts").groupBy("case_id", "rule").agg(F.count("*").alias("n"))


# --- single readers and exports


@query("src_xlsx", f"""
WITH {CUSTOMER_FILES_SQL} SELECT 'f' || f || '.xlsx' AS path, (n + 1)::BIGINT AS row, day AS event_time, c_acctbal AS amount, c_name AS sender, 'S' || c_custkey AS receiver, said AS narration FROM c WHERE kind = 4
""")  # fmt: skip
def src_xlsx(spark, sf):
    """The rows of workbooks: numbers, shared and inline texts."""
    u = evidence.of_files(mixed_files(spark, sf)).where("source_type = 'spreadsheet'")
    x = lambda f: F.col("fields")[f]
    return u.select("path", "row", x("event_time").alias("event_time"), x("amount").cast("double").alias("amount"), x("sender").alias("sender"), x("receiver").alias("receiver"), x("narration").alias("narration"))


@query("src_tabular", f"""
WITH {CUSTOMER_FILES_SQL} SELECT 'f' || f || '.csv' AS path, 'bank_record' AS source_type, n + 1 AS row, 'Payee' AS receiver_column, 'S' || c_custkey AS receiver, 6 AS cells FROM c WHERE kind = 0
UNION ALL SELECT 'f' || f || '.csv', 'cdr', n + 1, 'Terminating number', 'B' || c_custkey, 5 FROM c WHERE kind = 1
""")  # fmt: skip
def src_tabular(spark, sf):
    """Bank tables and call data, each by its own aliases: the column that holds the receiver, and how many cells a row has."""
    u = evidence.of_files(mixed_files(spark, sf)).where("source_type IN ('bank_record', 'cdr')")
    held = F.get(F.filter(F.map_entries("cells"), lambda c: c["value"] == F.col("fields")["receiver"]), F.lit(0))["key"]
    return u.select("path", "source_type", "row", held.alias("receiver_column"), F.col("fields")["receiver"].alias("receiver"), F.size("cells").alias("cells"))


@query("src_text", f"WITH {CUSTOMER_FILES_SQL} SELECT 'f' || f || '.txt' AS path, n AS line, c_name || ' wrote' AS text FROM c WHERE kind = 5")
def src_text(spark, sf):
    """The lines of notes, read whole."""
    return files.lines(mixed_files(spark, sf).where("path LIKE '%.txt' AND NOT contains(CAST(content AS STRING), 'sent ')")).select("path", F.col("line").cast("long").alias("line"), "text")


@query("src_eml", f"""
WITH {CUSTOMER_FILES_SQL} SELECT 'f' || f || '.eml' AS path, 'a@x.io' AS sender, 'Hi' AS subject, string_agg(c_name || ' wrote' || chr(10), '' ORDER BY c_custkey) AS body, 0 AS attachments, NULL AS error FROM c WHERE kind = 3 GROUP BY f
""")  # fmt: skip
def src_eml(spark, sf):
    """Mails in a character set that nobody knows: read as UTF-8, and no error."""
    m = files.emails(mixed_files(spark, sf).where("path LIKE '%.eml'"))
    return m.select("path", F.col("headers")["From"].alias("sender"), F.col("headers")["Subject"].alias("subject"), "body", F.size("attachments").alias("attachments"), "error")


@query("src_eml_grounded", f"""
WITH {CUSTOMER_FILES_SQL} SELECT DISTINCT 'f' || f || '.eml' AS path, 'a@x.io' AS sender, 'b@x.io' AS receiver, TIMESTAMP '2024-03-12 15:45:00' AS at, 'a@x.io,b@x.io' AS addresses FROM c WHERE kind = 3
""")  # fmt: skip
def src_eml_grounded(spark, sf):
    """What the headers state goes before what the text reads like."""
    e = files.email_facts(files.emails(mixed_files(spark, sf).where("path LIKE '%.eml'")))
    return e.select("path", "sender", "receiver", "at", F.array_join("email_addresses", ",").alias("addresses"))


@query("dispatch_ext", f"""
WITH {CUSTOMER_FILES_SQL} SELECT DISTINCT 'f' || f AS name, ['csv', 'csv', 'text', 'text', 'spreadsheet', 'text', NULL][kind + 1] AS parser, kind = 4 AS zipped FROM c
""")  # fmt: skip
def dispatch_ext(spark, sf):
    """The reader that a file's extension names, and whether its first bytes are an archive's."""
    m = mixed_files(spark, sf)
    return m.select(
        F.substring_index("path", ".", 1).alias("name"), files.parser_of(F.substring_index("path", ".", -1)).alias("parser"), (files.sniff_mime(F.col("content")) == "application/zip").alias("zipped")
    )


@query("sink_export", """
SELECT form, o_orderkey, replace(o_orderpriority, 'URGENT', 'Protected person A') || ', "x"' AS said, '["' || o_orderstatus || '","y"]' AS marks FROM orders, (SELECT unnest(['csv', 'json']) AS form)
""")  # fmt: skip
def sink_export(spark, sf):
    """Orders exported as CSV and as JSON, the alias redacted, arrays encoded; read again."""
    o = s.read(spark, sf, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(', "x"')).alias("said"), F.array("o_orderstatus", F.lit("y")).alias("marks"))
    out = None
    for form in ("csv", "json"):
        path = shared_path(spark, form)
        sinks.export(o, path, form, alias="URGENT")
        back = spark.read.option("header", "true").option("escape", '"').csv(path) if form == "csv" else spark.read.json(path).withColumn("marks", F.to_json("marks"))
        back = back.select(F.lit(form).alias("form"), F.col("o_orderkey").cast("long").alias("o_orderkey"), "said", "marks")
        out = back if out is None else out.unionByName(back)
    return out
