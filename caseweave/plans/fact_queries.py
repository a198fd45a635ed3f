"""Extraction, facts, grounding and review over reports whose facts are known from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical, moments, scores
from ..functions import identifiers as ids
from ..operators import facts, records
from . import standins as s
from .standins import REPORTS_SQL, query


@query("find_amount_and_time", f"WITH {REPORTS_SQL} SELECT k, round(amount, 2) AS value, 'INR' AS currency, 'payment' AS role, date_trunc('minute', moment) AS at, 'exact' AS precision FROM reps")
def find_amount_and_time(spark, sf):
    r = s.reports(spark, sf).select("k", moments.find_amount_detail(F.col("text")).alias("a"), moments.find_timestamp(F.col("text")).alias("t"))
    return r.select("k", "a.value", "a.currency", "a.role", "t.at", "t.precision")


@query("find_timestamp_forms", """
SELECT event_id, date_trunc('minute', ts)::TIMESTAMP - CASE event_id % 5 WHEN 3 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END AS at, 'exact' AS precision FROM events WHERE event_id % 5 <> 4
UNION ALL SELECT event_id, date_trunc('day', ts)::TIMESTAMP, 'date_only' FROM events WHERE event_id % 5 = 4
""")  # fmt: skip
def find_timestamp_forms(spark, sf):
    """One moment written in five ways."""
    form = lambda f: F.date_format("ts", f)
    n = F.col("event_id") % 5
    text = (
        F.when(n == 0, form("dd/MM/yyyy, HH:mm")).when(n == 1, form("yyyy-MM-dd'T'HH:mm")).when(n == 2, F.concat(form("hh:mm a"), F.lit(" on "), form("d MMM yyyy")))
        .when(n == 3, F.concat(form("dd MMM yyyy HH:mm"), F.lit(":00 +0530"))).otherwise(form("dd-MM-yyyy"))
    )
    return s.read(spark, sf, "events").select("event_id", moments.find_timestamp(F.concat(F.lit("seen "), text, F.lit(" there"))).alias("t")).select("event_id", "t.at", "t.precision")


@query("find_person_roles", f"""
WITH {REPORTS_SQL} SELECT k, CASE WHEN accused < witness THEN accused || ': accused, ' || witness || ': witness' ELSE witness || ': witness, ' || accused || ': accused' END AS roles FROM reps
""")  # fmt: skip
def find_person_roles(spark, sf):
    roles = F.array_join(F.transform(moments.find_person_roles(F.col("text")), lambda x: F.concat_ws(": ", x["name"], x["role"])), ", ")
    return s.reports(spark, sf).select("k", roles.alias("roles"))


@query("find_locations", f"WITH {REPORTS_SQL} SELECT k, 'Andheri East,Crawford Market,Linking Road' AS places FROM reps")
def find_locations(spark, sf):
    return s.reports(spark, sf).select("k", F.array_join(moments.find_locations(F.col("text")), ",").alias("places"))


@query("find_report_header", f"WITH {REPORTS_SQL} SELECT k, fir, sections, 'Andheri East' AS station FROM reps")
def find_report_header(spark, sf):
    t = F.col("text")
    return s.reports(spark, sf).select(
        "k", ids.find_fir_number(t).alias("fir"), F.array_join(moments.find_fir_sections(t), ",").alias("sections"), moments.find_police_station(t).alias("station")
    )


def _documents(spark, sf):
    return s.reports(spark, sf).select(F.col("k").alias("unit_id"), "text")


@query("find_person_vehicle_links", f"WITH {REPORTS_SQL} SELECT k AS unit_id, witness AS a, plate AS b, 'Witness ' || witness || ' was driving ' || plate || '.' AS sentence FROM reps")
def find_person_vehicle_links(spark, sf):
    return records.person_vehicle_links(_documents(spark, sf))


@query("find_vehicle_location_links", f"WITH {REPORTS_SQL} SELECT k AS unit_id, plate AS a, 'Linking Road' AS b, 'Vehicle ' || plate || ' was observed parked near Linking Road.' AS sentence FROM reps")
def find_vehicle_location_links(spark, sf):
    return records.vehicle_location_links(_documents(spark, sf))


@query("find_person_location_links", f"WITH {REPORTS_SQL} SELECT k AS unit_id, accused AS a, 'Crawford Market' AS b, 'Accused ' || accused || ' was seen near Crawford Market.' AS sentence FROM reps")
def find_person_location_links(spark, sf):
    return records.person_location_links(_documents(spark, sf))


@query("find_identifiers", """
SELECT c_custkey, '+91' || (9000000000 + c_custkey) AS phones, (100000000 + c_custkey) || ',HDFC0' || lpad((c_custkey % 1000000)::VARCHAR, 6, '0') || ',user' || c_custkey || '@okbank' AS accounts,
  'DEV-' || lpad(c_custkey::VARCHAR, 8, '0') AS device, 'TXN' || lpad(c_custkey::VARCHAR, 7, '0') AS reference,
  CASE c_custkey % 3 WHEN 0 THEN 'Sharma Traders' WHEN 1 THEN 'Bharat Steel Pvt Ltd' ELSE 'State Bank of India' END AS organisation
FROM customer
""")  # fmt: skip
def find_identifiers(spark, sf):
    """All extractors over one text a customer that states one of each kind."""
    k = F.col("c_custkey")
    n = lambda c, w: F.lpad(c.cast("string"), w, "0")
    company = F.when(k % 3 == 0, "Sharma Traders").when(k % 3 == 1, "Bharat Steel Pvt Ltd").otherwise("State Bank of India")
    text = F.concat(
        F.lit("call +91 "), (k + 9_000_000_000).cast("string"), F.lit("\nAccount No: "), (k + 100_000_000).cast("string"), F.lit(" at hdfc, code HDFC0"), n(k % 1_000_000, 6),
        F.lit("\npay user"), k.cast("string"), F.lit("@okbank or a.b@mail.example.com\ndevice id: DEV-"), n(k, 8), F.lit("\ntxn id TXN"), n(k, 7), F.lit("\nfrom "), company, F.lit(", there"),
    )
    t = F.col("t")
    joined = lambda c: F.array_join(c, ",")
    return s.read(spark, sf, "customer").select("c_custkey", text.alias("t")).select(
        "c_custkey", joined(ids.find_phone_numbers(t)).alias("phones"), joined(ids.find_account_identifiers(t)).alias("accounts"), ids.find_device_identifier(t).alias("device"),
        ids.find_transaction_reference(t).alias("reference"), joined(ids.find_organisations(t)).alias("organisation"),
    )


@query("find_identifiers_in_documents", r"""
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'), lambda x: lower(x)))), ','), '') AS emails,
  coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b'))), ','), '') AS addresses, 0 AS plates, 0 AS organisations
FROM documents
""")  # fmt: skip
def find_identifiers_in_documents(spark, sf):
    """Every extractor over every document; plates and organisations occur in none."""
    t = F.col("text")
    return s.read(spark, sf, "documents").select(
        "doc_id", F.array_join(ids.find_email_addresses(t), ",").alias("emails"), F.array_join(ids.find_ip_addresses(t), ",").alias("addresses"),
        F.size(ids.find_vehicle_identifiers(t)).alias("plates"), F.size(ids.find_organisations(t)).alias("organisations"),
    )


@query("extract_indicators", f"""
WITH {s.OCCURRENCES_SQL}, e AS (SELECT DISTINCT evidence_id, key FROM occ WHERE entity_type = 'email'), ip AS (SELECT DISTINCT evidence_id, key FROM occ WHERE entity_type = 'ip')
SELECT evidence_id AS doc_id, 'email' AS entity_type, key AS normalized, 0.93::DOUBLE AS confidence FROM e UNION ALL SELECT evidence_id, 'upi_id', key, 0.93 FROM e
UNION ALL SELECT evidence_id, 'ip_address', key, 0.86 FROM ip
""")  # fmt: skip
def extract_indicators(spark, sf):
    """The older vocabulary, in which an e-mail address reads as a payment handle too."""
    d = s.read(spark, sf, "documents").where(F.col("text").rlike("[@0-9]")).select("doc_id", F.explode(ids.indicators(F.col("text"))).alias("x"))
    return d.select("doc_id", "x.entity_type", "x.normalized", "x.confidence").where("entity_type IN ('email', 'upi_id', 'ip_address')")


@query("extract_indicators_in_reports", f"""
WITH {REPORTS_SQL} SELECT k, 'utr' AS entity_type, lower(reference) AS normalized, 0.93::DOUBLE AS confidence FROM reps
""")  # fmt: skip
def extract_indicators_in_reports(spark, sf):
    d = s.reports(spark, sf).select("k", F.explode(ids.indicators(F.col("text"))).alias("x"))
    return d.select("k", "x.entity_type", "x.normalized", "x.confidence")


FACTS_SQL = f"""
WITH {REPORTS_SQL}, f AS (
  SELECT k * 10 + 1 AS unit_id, 'location_names' AS kind, 'Andheri East' AS value, 0.65::DOUBLE AS confidence FROM reps
  UNION ALL SELECT k * 10 + 3, 'person_names', accused, 0.75 FROM reps UNION ALL SELECT k * 10 + 3, 'person_roles', accused || ': accused', 0.75 FROM reps
  UNION ALL SELECT k * 10 + 4, 'vehicle_identifiers', plate, 0.93 FROM reps
  UNION ALL SELECT k * 10 + 4, 'person_names', witness, 0.75 FROM reps UNION ALL SELECT k * 10 + 4, 'person_roles', witness || ': witness', 0.75 FROM reps
  UNION ALL SELECT k * 10 + 5, 'vehicle_identifiers', plate, 0.93 FROM reps UNION ALL SELECT k * 10 + 5, 'location_names', 'Linking Road', 0.65 FROM reps
  UNION ALL SELECT k * 10 + 6, 'phone_numbers', phone, 0.94 FROM reps UNION ALL SELECT k * 10 + 6, 'transaction_reference', reference, 0.95 FROM reps
  UNION ALL SELECT k * 10 + 6, 'amount', printf('%.2f', amount), 0.96 FROM reps
  UNION ALL SELECT k * 10 + 7, 'person_names', accused, 0.75 FROM reps UNION ALL SELECT k * 10 + 7, 'person_roles', accused || ': accused', 0.75 FROM reps
  UNION ALL SELECT k * 10 + 7, 'location_names', 'Crawford Market', 0.65 FROM reps
)"""


@query("identifier_facts", FACTS_SQL + " SELECT * FROM f")
def identifier_facts(spark, sf):
    return facts.identifier_facts(s.report_units(spark, sf))


@query("build_records", FACTS_SQL + """
SELECT k * 10 + u AS unit_id, coalesce(max(value) FILTER (kind = 'person_names'), '') AS people, coalesce(max(value) FILTER (kind = 'location_names'), '') AS places,
  coalesce(max(value) FILTER (kind = 'vehicle_identifiers'), '') AS plates, coalesce(max(value) FILTER (kind = 'phone_numbers'), '') AS phones,
  max(value) FILTER (kind = 'transaction_reference') AS reference, max(CASE WHEN u = 6 THEN round(amount, 2) END) AS amount, max(CASE WHEN u = 6 THEN date_trunc('minute', moment) END) AS at
FROM reps CROSS JOIN (SELECT unnest(range(8)) AS u) LEFT JOIN f ON f.unit_id = k * 10 + u GROUP BY 1
""")  # fmt: skip
def build_records(spark, sf):
    """All extractors over the lines of every report."""
    r = records.build_records(s.report_units(spark, sf).withColumns({"case_id": F.lit(0), "source_type": F.lit("fir")}))
    joined = lambda c: F.array_join(c, ", ")
    return r.select(
        "unit_id", joined("person_names").alias("people"), joined("location_names").alias("places"), joined("vehicle_identifiers").alias("plates"), joined("phone_numbers").alias("phones"),
        F.col("transaction_reference").alias("reference"), F.col("amount.value").alias("amount"), F.col("moment.at").alias("at"),
    )


@query("cell_facts", """
WITH c AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderdate AS d, o_orderpriority AS n FROM orders)
SELECT k AS unit_id, 'amount' AS kind, printf('%.2f', p) AS value, 0.98::DOUBLE AS confidence FROM c
UNION ALL SELECT k, 'event_time', strftime(d, '%Y-%m-%dT%H:%M:00'), 0.98 FROM c UNION ALL SELECT k, 'event_time_precision', 'exact', 0.98 FROM c
UNION ALL SELECT k, 'narration', n, 0.99 FROM c UNION ALL SELECT k, 'phone_numbers', '+9198765' || lpad((k % 100000)::VARCHAR, 5, '0'), 0.96 FROM c UNION ALL SELECT k, 'sender', n, 0.97 FROM c
""")  # fmt: skip
def cell_facts(spark, sf):
    o = s.read(spark, sf, "orders")
    cell = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("raw"))
    cells = F.array(
        cell("amount", F.format_number("o_totalprice", 2)), cell("event_time", F.date_format("o_orderdate", "dd/MM/yyyy HH:mm")), cell("narration", F.col("o_orderpriority")),
        cell("phone_numbers", F.concat(F.lit("98765-"), F.lpad((F.col("o_orderkey") % 100000).cast("string"), 5, "0"))), cell("sender", F.col("o_orderpriority")),
        cell("amount", F.lit("none stated")), cell("event_time", F.lit("unknown")),
    )
    return facts.cell_facts(o.select(F.col("o_orderkey").alias("unit_id"), F.explode(cells).alias("x")).select("unit_id", "x.*"))


@query("report_enrichment", f"""
WITH {REPORTS_SQL} SELECT k * 10 AS unit_id, 'fir_number' AS kind, fir AS value, 0.97::DOUBLE AS confidence FROM reps UNION ALL SELECT k * 10, 'fir_sections', sections, 0.94 FROM reps
UNION ALL SELECT k * 10, 'police_station', 'Andheri East', 0.95 FROM reps UNION ALL SELECT k * 10 + 4, 'stated_vehicle_use', witness || ' > ' || plate, 0.82 FROM reps
UNION ALL SELECT k * 10 + 5, 'stated_vehicle_presence', plate || ' > Linking Road', 0.80 FROM reps UNION ALL SELECT k * 10 + 7, 'stated_presence', accused || ' > Crawford Market', 0.78 FROM reps
""")  # fmt: skip
def report_enrichment(spark, sf):
    documents = s.reports(spark, sf).select(F.col("k").alias("evidence_id"), "text")
    return facts.report_enrichment(documents, s.report_units(spark, sf))


@query("block_scoped_facts", f"""
WITH {REPORTS_SQL} SELECT k AS evidence_id, 'amount' AS kind, printf('%.2f', amount) AS value, 6 AS place, 0.94::DOUBLE AS confidence FROM reps UNION ALL SELECT k, 'transaction_reference', reference, 6, 0.93 FROM reps
""")  # fmt: skip
def block_scoped_facts(spark, sf):
    return facts.block_scoped_facts(s.report_units(spark, sf), "evidence_id")


@query("best_timestamp", """
WITH b AS (SELECT user_id, event_id AS place, CASE event_type WHEN 'view' THEN 'exact' WHEN 'error' THEN 'time_only' WHEN 'purchase' THEN 'unknown' ELSE 'date_only' END AS p, ts FROM events WHERE event_id % 3 = user_id % 3 OR event_type <> 'view'),
d AS (SELECT user_id, arg_min(p, ((CASE p WHEN 'exact' THEN 0 ELSE 1 END), place)) AS p, arg_min(ts, ((CASE p WHEN 'exact' THEN 0 ELSE 1 END), place)) AS ts FROM b WHERE p IN ('exact', 'date_only') GROUP BY 1),
c AS (SELECT user_id, arg_min(ts, place) AS clock FROM b WHERE p = 'time_only' GROUP BY 1)
SELECT coalesce(d.user_id, c.user_id) AS user_id,
  CASE WHEN d.p = 'exact' THEN date_trunc('minute', ts) WHEN clock IS NULL THEN date_trunc('day', ts)::TIMESTAMP
    WHEN ts IS NOT NULL THEN date_trunc('day', ts)::TIMESTAMP + to_minutes((hour(clock) * 60 + minute(clock))::BIGINT) END AS at,
  CASE WHEN d.p = 'exact' THEN 'exact' WHEN d.p IS NULL THEN 'time_only' WHEN clock IS NULL THEN 'date_only' ELSE 'approximate' END AS precision
FROM d FULL JOIN c ON d.user_id = c.user_id
""")  # fmt: skip
def best_timestamp(spark, sf):
    """Blocks that write a day and a clock, a day alone, a clock alone or nothing."""
    kind = F.when(F.col("event_type") == "view", "exact").when(F.col("event_type") == "error", "time_only").when(F.col("event_type") == "purchase", "unknown").otherwise("date_only")
    form = lambda f: F.date_format("ts", f)
    text = F.when(kind == "exact", form("dd/MM/yyyy HH:mm")).when(kind == "time_only", form("hh:mm a")).when(kind == "date_only", form("d MMM yyyy")).otherwise("no time")
    e = s.read(spark, sf, "events").where("event_id % 3 = user_id % 3 OR event_type <> 'view'")
    blocks = e.select("user_id", F.col("event_id").alias("place"), moments.find_timestamp(text).alias("t")).select("user_id", "place", "t.*")
    return records.best_timestamp(blocks, "user_id").select("user_id", "at", "precision")


@query("field_reference", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'cell:B' || o_custkey WHEN o_orderstatus = 'O' THEN 'row:' || o_orderkey ELSE 'record:' || o_orderkey END AS reference FROM orders")
def field_reference(spark, sf):
    o = s.read(spark, sf, "orders")
    k = F.col("o_orderkey").cast("string")
    f, r = F.concat(F.lit("cell:B"), F.col("o_custkey").cast("string")), F.concat(F.lit("row:"), k)
    provenance = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("sender"), f, F.lit("receiver"), r)).when(F.col("o_orderstatus") == "O", F.create_map(F.lit("sender"), F.lit(""), F.lit("receiver"), r)).otherwise(F.create_map(F.lit("note"), r))
    return o.select("o_orderkey", facts.field_reference(provenance, ["sender", "receiver"], F.concat(F.lit("record:"), k)).alias("reference"))


@query("canonicalize_indicator", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'phone' WHEN 1 THEN 'upi' WHEN 2 THEN 'reference' WHEN 3 THEN 'organisation' END AS entity_type,
  CASE c_custkey % 5 WHEN 0 THEN (9000000000 + c_custkey)::VARCHAR WHEN 1 THEN 'user' || c_custkey || '@okbank' WHEN 2 THEN 'ref000' || c_custkey || '01' WHEN 3 THEN 'steel works ' || c_custkey END AS key
FROM customer
""")  # fmt: skip
def canonicalize_indicator(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_custkey") % 5
    c = k.cast("string")
    kind = F.when(n == 0, "phone").when(n == 1, "upi_id").when(n == 2, "utr").when(n == 3, "organisation").otherwise("url")
    value = (
        F.when(n == 0, F.concat(F.lit("+91 "), (k + 9_000_000_000).cast("string"))).when(n == 1, F.concat(F.lit("User"), c, F.lit("@OkBank"))).when(n == 2, F.concat(F.lit("REF-OOO"), c, F.lit("oI")))
        .when(n == 3, F.concat(F.lit("Steel Works "), c, F.lit(" Pvt. Ltd."))).otherwise("https://a.example.com")
    )
    out = s.read(spark, sf, "customer").select("c_custkey", facts.canonicalize_indicator(kind, value).alias("x"))
    return out.select("c_custkey", "x.entity_type", "x.key")


@query("classify_account", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'upi' WHEN 2 THEN 'ifsc' ELSE 'account' END AS kind FROM customer")
def classify_account(spark, sf):
    k = F.col("c_custkey").cast("string")
    n = F.col("c_custkey") % 4
    value = F.when(n == 0, F.concat(F.lit("a"), k, F.lit("@mail.example.com"))).when(n == 1, F.concat(F.lit("a"), k, F.lit("@okbank"))).when(n == 2, F.concat(F.lit("hdfc0"), F.lpad(k, 6, "0"))).otherwise(F.lpad(k, 12, "1"))
    return s.read(spark, sf, "customer").select("c_custkey", canonical.classify_account(value).alias("kind"))


@query("normalize_identifier", """
SELECT c_custkey, 'user' || c_custkey || '@mail.example.com' AS email, '1234' || c_custkey AS account, 'ref-' || c_custkey AS reference, '+91' || (9000000000 + c_custkey) AS phone FROM customer
""")  # fmt: skip
def normalize_identifier(spark, sf):
    k = F.col("c_custkey").cast("string")
    n = canonical.normalize_identifier
    return s.read(spark, sf, "customer").select(
        "c_custkey", n("email", F.concat(F.lit(" User"), k, F.lit("@Mail.Example.com);"))).alias("email"), n("account_number", F.concat(F.lit("12 34-"), k)).alias("account"),
        n("transaction_reference", F.concat(F.lit("REF-"), k, F.lit("..)"))).alias("reference"), n("phone", F.concat(F.lit("0"), (F.col("c_custkey") + 9_000_000_000).cast("string"))).alias("phone"),
    )


@query("normalize_organisation", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN 'limited' ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) END AS key FROM part
""")  # fmt: skip
def normalize_organisation(spark, sf):
    """Names with no, one or several legal forms behind them, and a legal form alone."""
    n = F.col("p_partkey") % 4
    name = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat("p_name", F.lit(" Pvt. Ltd."))).when(n == 2, F.concat("p_name", F.lit(", Inc LLP"))).otherwise("Limited")
    return s.read(spark, sf, "part").select("p_partkey", canonical.normalize_organisation(name).alias("key"))


EVENT_TEXT = "CASE event_id % 4 WHEN 0 THEN 'AMOUNT: ' || printf('%.2f', value * 100) || ' on ' || strftime(ts, '%d/%m/%Y, %H:%M') WHEN 1 THEN strftime(ts, '%d-%m-%Y') || ' noted' WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' sent' ELSE 'ok' END"


@query("events_from_records", f"""
WITH e AS (SELECT *, {EVENT_TEXT} AS text FROM events)
SELECT user_id AS evidence_id, event_id AS record_id, CASE WHEN event_id % 4 = 0 OR event_type = 'purchase' THEN 'financial_transaction' ELSE event_type END AS event_type,
  CASE event_id % 4 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('day', ts)::TIMESTAMP ELSE date_trunc('second', ts) END AS at,
  CASE event_id % 4 WHEN 1 THEN 'day' ELSE 'minute' END AS precision, CASE WHEN event_type = 'purchase' THEN 12.5 WHEN event_id % 4 = 0 THEN round(value * 100, 2) END AS amount,
  CASE WHEN event_type = 'purchase' THEN 'ann b' END AS sender, CASE WHEN event_type = 'purchase' THEN 0.91::DOUBLE ELSE 0.78::DOUBLE END AS confidence
FROM e WHERE length(trim(text)) >= 3
""")  # fmt: skip
def events_from_records(spark, sf):
    e = s.read(spark, sf, "events")
    n = F.col("event_id") % 4
    form = lambda f: F.date_format("ts", f)
    text = (
        F.when(n == 0, F.concat(F.lit("AMOUNT: "), F.format_string("%.2f", F.col("value") * 100), F.lit(" on "), form("dd/MM/yyyy, HH:mm"))).when(n == 1, F.concat(form("dd-MM-yyyy"), F.lit(" noted")))
        .when(n == 2, F.concat(form("yyyy-MM-dd HH:mm:ss"), F.lit(" sent"))).otherwise("ok")
    )
    bank = F.col("event_type") == "purchase"
    columns = F.when(bank, F.create_map(F.lit("amount"), F.lit("12.50"), F.lit("from"), F.lit(" Ann B "))).otherwise(F.create_map().cast("map<string,string>"))
    rows = e.select(F.col("user_id").alias("evidence_id"), F.col("event_id").alias("record_id"), F.when(bank, "bank_transaction").otherwise(F.col("event_type")).alias("record_type"), text.alias("text"), columns.alias("columns"))
    return facts.events_from_records(rows).select("evidence_id", "record_id", "event_type", "at", "precision", "amount", "sender", "confidence")


@query("ocr_document_events", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT doc_id AS evidence_id, count(*) AS lines, md5(string_agg(trim(t), chr(10) ORDER BY i)[1:4000]) AS digest, 0.78::DOUBLE AS confidence FROM l WHERE trim(t) <> '' GROUP BY 1
""")  # fmt: skip
def ocr_document_events(spark, sf):
    d = s.read(spark, sf, "documents").select(F.col("doc_id").alias("evidence_id"), F.posexplode(F.split("text", "\n")).alias("line", "text"))
    return facts.ocr_document_events(d).select("evidence_id", "lines", F.md5("description").alias("digest"), "confidence")


@query("response_cache", """
WITH r AS (SELECT sha256(o_custkey || chr(31) || o_orderpriority) AS k, o_totalprice::VARCHAR AS payload, o_orderdate, o_orderkey FROM orders WHERE o_orderstatus = 'F')
SELECT q.c_custkey, b.payload IS NOT NULL AS cached, b.payload FROM (SELECT c_custkey, sha256(c_custkey || chr(31) || '1-URGENT') AS k FROM customer) q
LEFT JOIN (SELECT k, arg_max(payload, (o_orderdate, o_orderkey)) AS payload FROM r GROUP BY 1) b USING (k)
""")  # fmt: skip
def response_cache(spark, sf):
    o = s.read(spark, sf, "orders")
    runs = o.select(facts.cache_key(F.col("o_custkey"), F.col("o_orderpriority")).alias("cache_key"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"),
                    F.col("o_totalprice").cast("string").alias("payload"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("run_id"))
    requests = s.read(spark, sf, "customer").select("c_custkey", facts.cache_key(F.col("c_custkey"), F.lit("1-URGENT")).alias("cache_key"))
    return facts.response_cache(requests, runs).select("c_custkey", "cached", "payload")


@query("grounding_validate", f"""
WITH {REPORTS_SQL} SELECT k AS record_id, 'sender' AS field, k % 4 IN (0, 1) AS grounded, CASE WHEN k % 5 = 0 THEN 'parsed' WHEN k % 4 = 0 THEN 'claimed' WHEN k % 4 = 1 THEN accused END AS value, k % 5 = 0 AS disagrees FROM reps
""")  # fmt: skip
def grounding_validate(spark, sf):
    """Quotes that stand in the source whole or nearly, that don't, and that cite another source; a list keeps what stands there."""
    r = s.reports(spark, sf)
    k, n = F.col("k"), F.col("k") % 4
    accused = F.regexp_extract("text", r"Accused: ([^.]+)", 1)
    quote = F.when(n == 0, "Vehicle  was OBSERVED parked near linking road here").when(n == 2, "words that stand nowhere in it").otherwise("parked near Linking Road")
    quote = F.when(n == 0, F.concat(F.lit("under section Police station: ANDHERI east paid inr utr nowhere"))).otherwise(quote)
    claims = r.select(k.alias("record_id"), F.lit("sender").alias("field"), F.when(n == 1, F.concat(accused, F.lit("; Nobody Here"))).otherwise("claimed").alias("value"), quote.alias("quote"), F.when(n == 3, "other").otherwise("text").alias("citation"))
    parsed = F.when(k % 5 == 0, F.create_map(F.lit("sender"), F.lit("parsed"))).otherwise(F.create_map().cast("map<string,string>"))
    return records.ground(claims, r.select(k.alias("record_id"), "text", F.array(F.lit("text")).alias("citations"), parsed.alias("parsed")))


REVIEW_SQL = """
WITH r AS (SELECT o_orderkey AS k, o_orderstatus AS st, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 11) / 10.0 END AS v FROM orders),
c AS (SELECT *, CASE WHEN v IS NULL THEN round_even(0.9::DOUBLE * 0.75, 4) ELSE round_even(0.4::DOUBLE * 0.9 + 0.6::DOUBLE * v, 4) END AS score FROM r)
SELECT k, score AS confidence, CASE WHEN k % 5 = 0 THEN 'mismatch' WHEN v IS NULL THEN 'unvalidated' WHEN v >= 0.6 THEN 'validated' ELSE 'mismatch' END AS validation_status,
  concat_ws('; ', CASE WHEN k % 5 = 0 THEN 'Conflicting readings were preserved for: amount, sender' WHEN v < 0.6 THEN 'Claimed values could not be located in the raw extraction with sufficient agreement' END,
    CASE WHEN score < 0.85 THEN 'Combined confidence is below the 0.85 review threshold' END, CASE WHEN k % 3 = 0 THEN 'Identity or role is inferred for: receiver' END,
    CASE WHEN st = 'F' THEN 'Record carries key findings: amount' END, CASE WHEN k % 13 = 0 THEN 'Source text contains sensitive content' END,
    CASE WHEN k % 6 = 1 THEN 'Source quality is degraded or incomplete: blurry, cropped' END, CASE WHEN st = 'P' THEN 'Record meaning is contextual' END) AS reasons
FROM c
"""


@query("classify_review", REVIEW_SQL)
def classify_review(spark, sf):
    o, k = s.read(spark, sf, "orders"), F.col("o_orderkey")
    empty = F.create_map().cast("map<string,string>")
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    rows = o.select(
        k.alias("k"), F.lit(0.9).alias("model_confidence"), F.when(k % 7 != 0, (k % 11) / F.lit(10.0)).alias("validation_confidence"),
        F.when(k % 13 == 0, "they made THREATS").otherwise("plain words").alias("text"), F.when(F.col("o_orderstatus") == "P", "inferred").otherwise("direct").alias("basis"),
        F.when(k % 3 == 0, F.create_map(F.lit("receiver"), F.lit("inferred"), F.lit("sender"), F.lit("unknown"))).otherwise(F.create_map(F.lit("receiver"), F.lit("direct"))).alias("bases"),
        F.map_concat(F.create_map(F.lit("receiver"), F.lit("x")), F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("amount"), F.lit("5"))).otherwise(empty)).alias("values"),
        F.when(k % 5 == 0, strings("sender", "amount", "sender")).otherwise(strings()).alias("conflicts"), F.when(k % 6 == 1, strings("cropped", "blurry", "scanned")).otherwise(strings("scanned")).alias("quality_flags"),
    )
    return records.classify_review(rows).select("k", "confidence", "validation_status", "reasons")


@query("escalation_reasons", """
WITH r AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'failed' WHEN 2 THEN 'rejected' ELSE 'succeeded' END AS st, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 11) / 10.0 END AS v FROM orders)
SELECT k, concat_ws('; ', CASE WHEN k % 9 = 0 THEN 'A reviewer requested re-analysis' END,
  CASE WHEN st IS NULL THEN 'No local model is configured' WHEN st = 'failed' THEN 'The local model was unavailable or returned an error' WHEN st = 'rejected' THEN 'The local output failed validation' END,
  CASE WHEN st = 'succeeded' AND v IS NULL THEN 'The local result could not be validated' WHEN st = 'succeeded' AND v < 0.85 THEN 'Local validation confidence ' || printf('%.2f', v) || ' is below 0.85' END,
  CASE WHEN st = 'succeeded' AND k % 5 = 0 THEN 'The local model conflicts with parser values for: amount' END, CASE WHEN st = 'succeeded' AND k % 3 = 0 THEN 'The local model cited unsupported values for: sender, receiver' END,
  CASE WHEN k % 6 = 1 THEN 'The source is visually degraded: blurry, incomplete' END) AS reasons FROM r
""")  # fmt: skip
def escalation_reasons(spark, sf):
    k = F.col("o_orderkey")
    strings = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    status = F.when(k % 4 == 1, "failed").when(k % 4 == 2, "rejected").when(k % 4 == 3, "succeeded")
    rows = s.read(spark, sf, "orders").select(
        k.alias("k"), (k % 9 == 0).alias("forced"), status.alias("local_status"), (k % 4 == 3).alias("local"), F.when(k % 7 != 0, (k % 11) / F.lit(10.0)).alias("validation_confidence"),
        F.when(k % 5 == 0, strings("amount")).otherwise(strings()).alias("conflicts"), F.when(k % 3 == 0, strings("sender", "receiver")).otherwise(strings()).alias("ungrounded"),
        F.when(k % 6 == 1, strings("incomplete", "blurry", "scanned")).otherwise(strings("scanned")).alias("quality_flags"),
    )
    return records.escalation(rows).select("k", F.concat_ws("; ", "escalation_reasons").alias("reasons"))


@query("stated_role_edges", f"""
WITH {REPORTS_SQL} SELECT 0 AS case_id, k AS record_id, witness AS subject, plate AS object, 'USED_VEHICLE' AS relation_type FROM reps
UNION ALL SELECT 0, k, accused, 'Crawford Market', 'LOCATED_AT' FROM reps UNION ALL SELECT 0, k, plate, 'Linking Road', 'LOCATED_AT' FROM reps
""")  # fmt: skip
def stated_role_edges(spark, sf):
    d = _documents(spark, sf)
    found = {"stated_vehicle_use": records.person_vehicle_links, "stated_presence": records.person_location_links, "stated_vehicle_presence": records.vehicle_location_links}
    out = d.select(F.lit(0).alias("case_id"), F.col("unit_id").alias("record_id"))
    for name, find in found.items():
        pairs = find(d).groupBy(F.col("unit_id").alias("_u")).agg(F.collect_list(F.struct("a", "b")).alias(name))
        out = out.join(pairs, F.col("record_id") == F.col("_u"), "left").drop("_u")
    return records.role_edges(out)


@query("project_transaction", """
WITH n AS (SELECT o_orderkey AS k, o_totalprice AS a FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 4 <> 3), x AS (SELECT o_orderkey AS k, o_totalprice - 1 AS a, o_orderkey % 5 = 0 AS r FROM orders WHERE o_orderkey % 3 <> 1)
SELECT coalesce(n.k, x.k) AS record_id, CASE WHEN x.k IS NULL THEN 'create' WHEN r THEN 'keep' WHEN n.k IS NULL THEN 'withdraw' ELSE 'refresh' END AS action,
  CASE WHEN x.k IS NOT NULL AND r THEN x.a ELSE n.a END AS amount FROM n FULL JOIN x ON n.k = x.k
""")  # fmt: skip
def project_transaction(spark, sf):
    k = F.col("o_orderkey")
    o = s.read(spark, sf, "orders")
    rows = o.select(k.alias("record_id"), F.when(k % 4 != 3, F.col("o_totalprice")).alias("amount"), F.when(F.col("o_orderstatus") == "P", "balance").otherwise("payment").alias("amount_role"))
    old = o.where(k % 3 != 1).select(k.alias("record_id"), (F.col("o_totalprice") - 1).alias("amount"), (k % 5 == 0).alias("reviewed"))
    return records.project_transactions(rows, old)


@query("confidence_phrase", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'stated directly' WHEN o_orderstatus = 'P' THEN 'inferred from context' WHEN o_orderkey % 10 = 0 THEN 'basis not recorded'
  WHEN c >= 0.85 THEN 'stated directly' WHEN c >= 0.7 THEN 'stated, with some reading' WHEN c >= 0.5 THEN 'inferred from context' ELSE 'weakly supported' END AS phrase
FROM (SELECT *, (o_orderkey % 100) / 100.0 AS c FROM orders)
""")  # fmt: skip
def confidence_phrase(spark, sf):
    k = F.col("o_orderkey")
    basis = F.when(F.col("o_orderstatus") == "F", "direct").when(F.col("o_orderstatus") == "P", "inferred")
    return s.read(spark, sf, "orders").select("o_orderkey", scores.confidence_phrase(F.when(k % 10 != 0, (k % 100) / F.lit(100.0)), basis).alias("phrase"))


@query("source_category_clean", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_')[1:64] AS category FROM part")
def source_category_clean(spark, sf):
    return s.read(spark, sf, "part").select("p_partkey", scores.source_category(F.col("p_type")).alias("category"))


@query("clock_words", "SELECT event_id, strftime(ts, '%H:%M') AS clock FROM events")
def clock_words(spark, sf):
    """A clock time however it is written, in 24 hours."""
    n = F.col("event_id") % 3
    text = F.when(n == 0, F.date_format("ts", "h:mm a")).when(n == 1, F.date_format("ts", "H:mm")).otherwise(F.date_format("ts", "h.mma"))
    return s.read(spark, sf, "events").select("event_id", scores.clock_time(text).alias("clock"))
