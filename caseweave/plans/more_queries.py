"""Grounding, reconciliation, review, text sources and set reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical, identifiers, scores
from ..operators import graph, records, resolve, rollups, rules, temporal
from ..sources import files
from . import standins as s
from .standins import EDGES_SQL, OCCURRENCES_SQL, RELATIONS_SQL, TRANSACTIONS_SQL, query


@query("src_lines", "SELECT doc_id, i + 1 AS line, length(trim(l)) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10)))))::INT AS i FROM documents) WHERE trim(l) <> ''")
def src_lines(spark, sf):
    d = s.read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "l"))
    return d.where(F.trim("l") != "").select("doc_id", (F.col("i") + 1).alias("line"), F.length(F.trim("l")).cast("long").alias("n"))


@query("src_paragraph", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE length(trim(l)) >= 3 GROUP BY 1")
def src_paragraph(spark, sf):
    d = s.read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return d.where(F.length(F.trim("l")) >= 3).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("hash_ingest", "SELECT page_id, sha256(html) AS hash, octet_length(encode(html)) <= 20000 AS accepted FROM pages")
def hash_ingest(spark, sf):
    p = s.read(spark, sf, "pages")
    return p.select("page_id", F.sha2("html", 256).alias("hash"), (F.octet_length("html") <= 20_000).alias("accepted"))


@query("sniff_mime", "SELECT page_id, CASE WHEN starts_with(html, '%PDF-') THEN 'application/pdf' WHEN starts_with(html, 'PK') THEN 'application/zip' ELSE 'text/plain' END AS mime FROM pages")
def sniff_mime(spark, sf):
    return s.read(spark, sf, "pages").select("page_id", files.sniff_mime(F.col("html").cast("binary")).alias("mime"))


@query("validation_confidence", "SELECT source AS record_id, count(*) AS checked, count(*) FILTER (n_chars > 900) AS grounded, round_even(count(*) FILTER (n_chars > 900) / count(*), 4) AS validation_confidence FROM documents GROUP BY 1")
def validation_confidence(spark, sf):
    return records.validation(s.read(spark, sf, "documents").select(F.col("source").alias("record_id"), (F.col("n_chars") > 900).alias("grounded")))


@query("reconcile_models", """
WITH l AS (SELECT l_orderkey AS record_id, l_linenumber::VARCHAR AS field, l_returnflag AS value, l_discount AS v FROM lineitem WHERE l_linenumber <= 3),
h AS (SELECT l_orderkey AS record_id, l_linenumber::VARCHAR AS field, l_linestatus AS value, l_tax AS v FROM lineitem WHERE l_linenumber >= 2)
SELECT record_id, field, CASE WHEN l.value IS NULL OR coalesce(h.v, -1) > coalesce(l.v, -1) THEN h.value ELSE l.value END AS value, coalesce(l.value <> h.value, false) AS conflict
FROM l FULL JOIN h USING (record_id, field)
""")  # fmt: skip
def reconcile_models(spark, sf):
    li = s.read(spark, sf, "lineitem")
    side = lambda v, w: li.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").cast("string").alias("field"), F.col(v).alias("value"), F.col(w).alias("validation"), "l_linenumber")
    return records.reconcile(side("l_returnflag", "l_discount").where("l_linenumber <= 3").drop("l_linenumber"), side("l_linestatus", "l_tax").where("l_linenumber >= 2").drop("l_linenumber"))


@query("call_log_edges", """
SELECT event_id AS record_id, least(a, b) AS subject, greatest(a, b) AS object, 'COMMUNICATED_WITH' AS relation_type, 0.75::DOUBLE AS confidence
FROM (SELECT event_id, right('987650' || lpad((user_id % 10000)::VARCHAR, 4, '0'), 10) AS a, right('987651' || lpad((event_id % 10000)::VARCHAR, 4, '0'), 10) AS b FROM events WHERE event_type = 'click')
""")  # fmt: skip
def call_log_edges(spark, sf):
    number = lambda head, c: F.concat(F.lit(f"+91 {head}"), F.lpad((F.col(c) % 10000).cast("string"), 4, "0"))
    e = s.read(spark, sf, "events").where("event_type = 'click'").select(
        F.lit(0).alias("case_id"), F.col("event_id").alias("record_id"), F.col("event_id").alias("evidence_id"), F.col("ts").alias("at"), F.lit("call_log").alias("source_type"),
        F.lit(None).cast("string").alias("sender"), F.lit(None).cast("string").alias("receiver"), F.array(number("987650", "user_id"), number("987651", "event_id")).alias("phone_numbers"))
    return resolve.call_log_edges(e).select("record_id", "subject", "object", "relation_type", "confidence")


@query("find_phone_numbers", "SELECT c_custkey, '+91' || lpad((9000000000 + c_custkey)::VARCHAR, 10, '0') AS phones FROM customer")
def find_phone_numbers(spark, sf):
    """Customer numbers written in groups and found again."""
    n = (F.lit(9_000_000_000) + F.col("c_custkey")).cast("string")
    text = F.concat(F.lit("call "), F.substring(n, 1, 5), F.lit(" "), F.substring(n, 6, 5), F.lit(" or +91-"), n, F.lit("."))
    return s.read(spark, sf, "customer").select("c_custkey", F.array_join(identifiers.find_phone_numbers(text), ",").alias("phones"))


@query("find_vehicle_identifiers", "SELECT c_custkey, 'MH' || lpad((c_custkey % 90 + 10)::VARCHAR, 2, '0') || 'AB' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS plates FROM customer")
def find_vehicle_identifiers(spark, sf):
    k = F.col("c_custkey")
    text = F.concat(F.lit("seen: mh "), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit("-ab "), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(", XX 12 AB 1234"))
    return s.read(spark, sf, "customer").select("c_custkey", F.array_join(identifiers.find_vehicle_identifiers(text), ",").alias("plates"))


@query("find_transaction_reference", "SELECT o_orderkey, 'REF' || lpad(o_orderkey::VARCHAR, 9, '0') AS reference FROM orders")
def find_transaction_reference(spark, sf):
    text = F.concat(F.lit("paid, UTR: REF"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(" txn id 12"))
    return s.read(spark, sf, "orders").select("o_orderkey", identifiers.find_transaction_reference(text).alias("reference"))


@query("canonicalize_reference", "SELECT o_orderkey, 'ref' || translate(o_orderkey::VARCHAR, '', '') || '00110' AS key FROM orders")
def canonicalize_reference(spark, sf):
    raw = F.concat(F.lit("REF-"), F.col("o_orderkey").cast("string"), F.lit("-OoIl0"))
    return s.read(spark, sf, "orders").select("o_orderkey", canonical.canonicalize("transaction_reference", raw)["key"].alias("key"))


@query("is_transactional", "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'P' THEN 'balance' END IS DISTINCT FROM 'balance'")
def is_transactional(spark, sf):
    o = s.read(spark, sf, "orders")
    return o.where(scores.is_transactional(F.when(F.col("o_orderstatus") == "P", "balance"))).select("o_orderkey")


@query("combined_confidence", "SELECT doc_id, CASE WHEN quality IS NULL THEN round_even(0.8::DOUBLE * 0.75, 4) ELSE round_even(0.4::DOUBLE * 0.8::DOUBLE + 0.6::DOUBLE * quality, 4) END AS confidence FROM documents LEFT JOIN labels USING (doc_id)")
def combined_confidence(spark, sf):
    d = s.read(spark, sf, "documents").select("doc_id").join(s.read(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", scores.combined_confidence(F.lit(0.8), F.col("quality").cast("double")).alias("confidence"))


@query("set_flags_degraded", "SELECT doc_id, contains(text, '***') AS blurred, contains(text, '!!') AS glare FROM documents WHERE contains(text, '***') OR contains(text, '!!')")
def set_flags_degraded(spark, sf):
    flags = F.array_compact(F.array(F.when(F.col("text").contains("***"), "blurred"), F.when(F.col("text").contains("!!"), "glare"), F.lit("scanned")))
    bad = F.array(F.lit("blurred"), F.lit("glare"))
    d = s.read(spark, sf, "documents").withColumn("f", flags).where(F.arrays_overlap("f", bad))
    return d.select("doc_id", F.array_contains("f", "blurred").alias("blurred"), F.array_contains("f", "glare").alias("glare"))


@query("omission_note", "SELECT source, count(*) AS shown, any_value(n) - count(*) AS further FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r <= 6 GROUP BY 1")
def omission_note(spark, sf):
    n = s.read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    shown = F.least("n", F.lit(6)).cast("long")
    return n.select("source", shown.alias("shown"), (F.col("n") - shown).alias("further"))


@query("briefing", f"""
WITH {TRANSACTIONS_SQL} SELECT case_id, id, amount, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY amount DESC, id)::INT AS rank FROM txns WHERE status <> 'P') WHERE rank <= 3
""")  # fmt: skip
def briefing(spark, sf):
    t = s.transactions(spark, sf).where("status <> 'P'").select("case_id", "id", "amount")
    return rollups.top_per(t, ["case_id"], [F.desc("amount"), F.asc("id")], 3)


@query("rule_pre_incident_communication", """
WITH c AS (SELECT user_id AS a, CAST(json_extract_string(props, '$.k') AS BIGINT) AS b, ts FROM events WHERE event_type <> 'error')
SELECT 0 AS case_id, 'PRE_INCIDENT_COMMUNICATION' AS rule, 'HIGH' AS severity, least(a, b) || ':' || greatest(a, b) AS key
FROM c WHERE a <> b AND ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-18' GROUP BY least(a, b), greatest(a, b) HAVING count(*) >= 2
""")  # fmt: skip
def rule_pre_incident(spark, sf):
    from .temporal_queries import pre_incident_contacts_events

    return rules.pair_rule(pre_incident_contacts_events(spark, sf), "PRE_INCIDENT_COMMUNICATION", "HIGH", "left", "right")


@query("rule_vehicle_corridor", "SELECT 0 AS case_id, 'VEHICLE_CORRIDOR' AS rule, 'MEDIUM' AS severity, user_id || ':' || count(DISTINCT event_type) AS key FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 3")
def rule_vehicle_corridor(spark, sf):
    from .temporal_queries import vehicle_corridor

    return rules.pair_rule(vehicle_corridor(spark, sf), "VEHICLE_CORRIDOR", "MEDIUM", "vehicle", "n_places")


@query("window_of_contacts", f"WITH {RELATIONS_SQL} SELECT subject, (min(at) - INTERVAL 2 DAY)::DATE AS from_day, (max(at) + INTERVAL 2 DAY)::DATE AS to_day FROM rels WHERE relation_type IN ('CALLED', 'MESSAGED') AND status <> 'rejected' GROUP BY 1")
def window_of_contacts(spark, sf):
    c = temporal.contacts(s.relations(spark, sf))
    return c.groupBy("subject").agg(F.date_sub(F.min("at").cast("date"), 2).alias("from_day"), F.date_add(F.max("at").cast("date"), 2).alias("to_day"))
