"""Correlation, alerts, integrity, graph read models and case reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import casereads, facts, graph, integrity, joins, rollups, rules, temporal, textindex
from ..operators.lineage import shared_checkpoint
from ..sources import files
from . import evidence_queries, fact_queries, more_queries, view_queries  # noqa: F401  their SQL is restated
from . import standins as s
from .standins import CASES_SQL, CONTACTS_SQL, EDGES_SQL, OCCURRENCES_SQL, ORACLES, QUERIES, RELATIONS_SQL, TRANSACTIONS_SQL, query
from .record_queries import MERKLE
from .temporal_queries import _live

# Correlation


def _txn_values(spark, sf):
    t = s.transactions(spark, sf)
    return t.select("case_id", F.col("id").alias("evidence_id"), F.col("id").alias("record_id"), F.lit("account").alias("field"), F.col("sender").cast("string").alias("value"))


def _txn_records(spark, sf):
    ref = F.concat(F.col("sender").cast("string"), F.lit("-"), "receiver").alias("reference")
    return s.transactions(spark, sf).select("case_id", F.col("id").alias("record_id"), F.col("id").alias("evidence_id"), ref, "amount", F.col("status").alias("currency"), "at")


SEMANTIC_SQL = """SELECT a.case_id, a.id AS "left", b.id AS "right", 0.45::DOUBLE AS confidence FROM txns a JOIN txns b
  ON a.case_id = b.case_id AND a.id < b.id AND abs(a.amount - b.amount) <= 500 AND abs(epoch(a.at) - epoch(b.at)) <= 21600 WHERE a.sender <> b.sender"""


@query("corr_classes", f"""
WITH {TRANSACTIONS_SQL} SELECT case_id, 'account' AS field, sender::VARCHAR AS value, count(*) AS records, count(DISTINCT id // 4) AS evidence,
  (count(*) * count(*) - (SELECT sum(n * n) FROM (SELECT count(*) AS n FROM txns u WHERE u.case_id = t.case_id AND u.sender = t.sender GROUP BY id // 4))::BIGINT) // 2 AS pairs, 0.85::DOUBLE AS confidence
FROM txns t GROUP BY case_id, sender HAVING count(*) >= 2
""")  # fmt: skip
def corr_classes(spark, sf):
    """Each shared account as a class with the number of its pairs; four orders are one evidence file."""
    return joins.value_classes(_txn_values(spark, sf).withColumn("evidence_id", F.floor(F.col("record_id") / 4)))


@query("corr_semantic", f"WITH {TRANSACTIONS_SQL} {SEMANTIC_SQL}")
def corr_semantic(spark, sf):
    return joins.semantic_candidates(_txn_records(spark, sf), _txn_values(spark, sf), tolerance=500.0)


@query("correlate", f"""
WITH {TRANSACTIONS_SQL}, x AS (
  SELECT a.case_id, a.id AS "left", b.id AS "right", 'SAME_IDENTIFIER' AS relation_type, 'account' AS fields, 0.85::DOUBLE AS confidence FROM txns a JOIN txns b ON a.case_id = b.case_id AND a.sender = b.sender AND a.id < b.id
), c AS (
  SELECT a.case_id, a.id, b.id, 'CONTRADICTION', concat_ws(',', CASE WHEN abs(a.amount - b.amount) > 0.01 THEN 'amount' END,
    CASE WHEN a.status <> b.status THEN 'currency' END, CASE WHEN abs(epoch(a.at) - epoch(b.at)) > 86400 THEN 'event_time' END) AS f, 0.8::DOUBLE
  FROM txns a JOIN txns b ON a.case_id = b.case_id AND a.sender = b.sender AND a.receiver = b.receiver AND a.id < b.id
), m AS ({SEMANTIC_SQL}), e AS (
  SELECT * FROM x UNION ALL SELECT * FROM c WHERE f <> '' UNION ALL SELECT case_id, "left", "right", 'CORROBORATION', 'amount,event_time', confidence FROM m
)
SELECT *, sha256(relation_type || chr(31) || fields || chr(31) || "left" || chr(31) || "right")[1:48] AS key FROM e
""")  # fmt: skip
def correlate(spark, sf):
    """Exact matches, contradictions and weak candidates, each key once."""
    named = lambda rows, kind, fields="fields": rows.select("case_id", "left", "right", F.lit(kind).alias("relation_type"), (F.col(fields) if fields == "fields" else F.lit(fields)).alias("fields"), F.col("confidence").cast("double").alias("confidence"))
    r, v = _txn_records(spark, sf), _txn_values(spark, sf)
    return joins.correlate(
        named(joins.exact_matches(v), "SAME_IDENTIFIER"), named(joins.contradictions(r), "CONTRADICTION"),
        named(joins.semantic_candidates(r, v, tolerance=500.0), "CORROBORATION", "amount,event_time"),
    )


@query("fill_sibling", """
WITH r AS (SELECT l_orderkey AS evidence_id, l_extendedprice AS amount, l_linenumber AS id, l_linenumber % 5 = 0 AS reviewed, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS sender FROM lineitem),
b AS (SELECT l_orderkey AS evidence_id, l_extendedprice + CASE WHEN l_suppkey % 2 = 0 THEN 0.01 ELSE 0.02 END AS amount, l_linenumber + 100 AS id, l_suppkey AS sender FROM lineitem WHERE l_linenumber % 2 = 1)
SELECT r.evidence_id, r.id, CASE WHEN r.sender IS NULL AND NOT reviewed THEN (SELECT arg_min(b.sender, b.id) FROM b WHERE b.evidence_id = r.evidence_id AND abs(b.amount - r.amount) <= 0.01 + 1e-9) ELSE r.sender END AS sender FROM r
""")  # fmt: skip
def fill_sibling(spark, sf):
    """Siblings a cent off fill, those two cents off don't."""
    li, n = s.read(spark, sf, "lineitem"), F.col("l_linenumber")
    rows = li.select(F.col("l_orderkey").alias("evidence_id"), F.col("l_extendedprice").alias("amount"), n.alias("id"), (n % 5 == 0).alias("reviewed"), F.when(n % 2 == 0, F.col("l_suppkey")).alias("sender"))
    off = F.when(F.col("l_suppkey") % 2 == 0, 0.01).otherwise(0.02)
    siblings = li.where(n % 2 == 1).select(F.col("l_orderkey").alias("evidence_id"), (F.col("l_extendedprice") + off).alias("amount"), (n + 100).alias("id"), F.col("l_suppkey").alias("sender"))
    return joins.fill_sibling(rows, siblings, ["sender"]).select("evidence_id", "id", "sender")


@query("prior_record_lookup", """
WITH e AS (SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 2 = 0 THEN 'phone' ELSE 'email' END AS t, CASE WHEN c_custkey % 4 <> 3 THEN 'k' || (c_custkey % 60) END AS key FROM customer),
p AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'email' ELSE 'phone' END AS t, 'k' || (s_suppkey % 60) AS key, s_name AS record_reference, DATE '2020-01-01' + (s_suppkey % 400)::INT AS registered_on FROM supplier)
SELECT entity_id, record_reference, registered_on, row_number() OVER (PARTITION BY entity_id ORDER BY registered_on DESC, record_reference)::INT AS rank FROM e JOIN p USING (t, key)
""")  # fmt: skip
def prior_record_lookup(spark, sf):
    c, k = s.read(spark, sf, "customer"), F.col("c_custkey")
    e = c.select(k.alias("entity_id"), F.when(k % 2 == 0, "phone").otherwise("email").alias("entity_type"), F.when(k % 4 != 3, F.concat(F.lit("k"), (k % 60).cast("string"))).alias("key"))
    n = F.col("s_suppkey")
    p = s.read(spark, sf, "supplier").select(
        F.when(n % 3 == 0, "email").otherwise("phone").alias("identifier_type"), F.concat(F.lit("k"), (n % 60).cast("string")).alias("identifier_value"), F.col("s_name").alias("record_reference"),
        F.date_add(F.lit("2020-01-01").cast("date"), (n % 400).cast("int")).alias("registered_on"),
    )
    return joins.prior_records(e, p)


CROSS_SQL = f"{s.SHARED_SQL}, o AS (SELECT DISTINCT case_id, entity_type, key FROM occ WHERE entity_type = 'email' AND evidence_id % 7 <> 0)"


@query("cross_case_entities", f"""
WITH {CROSS_SQL} SELECT a.case_id, b.case_id AS linked_case, a.entity_type, a.key FROM o a JOIN o b ON a.entity_type = b.entity_type AND a.key = b.key AND a.case_id <> b.case_id
""")  # fmt: skip
def cross_case_entities(spark, sf):
    """Unrejected entities of matchable types; network addresses are none."""
    o = s.shared_occurrences(spark, sf).withColumn("status", F.when(F.col("evidence_id") % 7 == 0, "rejected"))
    return joins.cross_case(joins.matchable(o))


@query("cross_case_all", f"""
WITH {CROSS_SQL}, h AS (
  SELECT DISTINCT source AS case_id, 'file' AS signal, sha256(text) AS label FROM documents UNION SELECT DISTINCT case_id, entity_type, key FROM o UNION SELECT DISTINCT source, 'reference', 'ref-' || (doc_id % 500) FROM documents WHERE doc_id % 3 = 0
), l AS (
  SELECT a.case_id, b.case_id AS linked_case, a.signal, a.label, CASE WHEN a.signal = 'file' THEN 'high' ELSE 'medium' END AS confidence
  FROM h a JOIN h b ON a.signal = b.signal AND a.label = b.label AND a.case_id <> b.case_id
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY CASE WHEN confidence = 'high' THEN 0 ELSE 1 END, label, linked_case)::INT AS rank FROM l) WHERE rank <= 80
""")  # fmt: skip
def cross_case_all(spark, sf):
    """Files, entities and references together; the strongest 80 links of each case."""
    d = s.read(spark, sf, "documents")
    ref = F.lower(F.trim(F.concat(F.lit(" REF-"), (F.col("doc_id") % 500).cast("string"))))
    references = d.where("doc_id % 3 = 0").select(F.col("source").alias("case_id"), F.lit("reference").alias("entity_type"), ref.alias("key"))
    links = QUERIES["cross_case_hash"](spark, sf).unionByName(cross_case_entities(spark, sf)).unionByName(joins.cross_case(references))
    links = links.select("case_id", "linked_case", F.col("entity_type").alias("signal"), F.col("key").alias("label"))
    return joins.rank_links(links.withColumn("confidence", F.when(F.col("signal") == "file", "high").otherwise("medium")))


# Alerts


@query("rule_shared_device", f"""
WITH {TRANSACTIONS_SQL} SELECT case_id, 'SHARED_DEVICE' AS rule, 'HIGH' AS severity, 'Dev-' || (sender % 40) AS key FROM txns WHERE sender % 5 <> 0 GROUP BY case_id, sender % 40 HAVING count(DISTINCT sender % 3) >= 2
""")  # fmt: skip
def rule_shared_device(spark, sf):
    """One number in two spellings is one owner; a record without a sender counts by its only number."""
    t, k = s.transactions(spark, sf), F.col("sender")
    number = F.concat(F.when(F.col("id") % 2 == 0, "+91 98765").otherwise("098765"), F.lpad((k % 3).cast("string"), 5, "0"))
    named = F.when(F.col("id") % 3 != 0, number)
    phones = F.when(k % 5 == 0, F.array(number, F.lit("9876599999"))).otherwise(F.array(number))
    return rules.shared_device(t.select("case_id", F.concat(F.lit(" Dev-"), (k % 40).cast("string")).alias("device"), F.when(k % 5 != 0, named).alias("sender"), phones.alias("phones")))


@query("rule_communication_burst", f"""
WITH {CONTACTS_SQL}, p AS (SELECT case_id, least(subject % 10, object % 5) AS a, greatest(subject % 10, object % 5) AS b, id, at FROM contacts WHERE status <> 'rejected'),
w AS (SELECT *, lag(at, 2) OVER (PARTITION BY case_id, a, b ORDER BY at, id) AS s FROM p)
SELECT DISTINCT case_id, 'COMMUNICATION_BURST' AS rule, 'MEDIUM' AS severity, a || ':' || b AS key FROM w WHERE epoch_us(at) - epoch_us(s) <= 7200000000
""")  # fmt: skip
def rule_communication_burst(spark, sf):
    a, b = F.col("subject") % 10, F.col("object") % 5
    rows = _live(spark, sf).withColumns({"left": F.least(a, b), "right": F.greatest(a, b)})
    return rules.pair_rule(temporal.bursts(rows, ["case_id", "left", "right"]), "COMMUNICATION_BURST", "MEDIUM", "left", "right")


@query("rule_converging_location", f"""
SELECT case_id, 'CONVERGING_LOCATION' AS rule, 'MEDIUM' AS severity, place || ':' || strftime(at, '%Y-%m-%dT%H:%M:%S') AS key FROM ({ORACLES["converging_location"]})
""")  # fmt: skip
def rule_converging_location(spark, sf):
    found = QUERIES["converging_location"](spark, sf)
    return rules.alert(found, "CONVERGING_LOCATION", "MEDIUM", F.col("place"), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"))


@query("rule_late_arriving_identity", """
SELECT 0 AS case_id, 'LATE_ARRIVING_IDENTITY' AS rule, 'LOW' AS severity, user_id::VARCHAR AS key FROM events GROUP BY user_id HAVING min(ts) >= TIMESTAMP '2024-01-01 12:00:00' + INTERVAL 24 HOUR
""")  # fmt: skip
def rule_late_arriving_identity(spark, sf):
    first = temporal.first_occurrence(s.read(spark, sf, "events"), ["user_id"], "ts", "event_id").select(F.lit(0).alias("case_id"), F.col("user_id").alias("entity_id"), "first_at")
    opened = s.cases(spark, sf).where("case_id = 0").select("case_id", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz").alias("created_at"))
    return rules.late_arrival(first, opened)


@query("rule_sudden_silence", f"""
SELECT case_id, 'SUDDEN_SILENCE' AS rule, 'MEDIUM' AS severity, subject || ':' || object AS key FROM ({ORACLES["sudden_silence"]})
""")  # fmt: skip
def rule_sudden_silence(spark, sf):
    return rules.pair_rule(QUERIES["sudden_silence"](spark, sf), "SUDDEN_SILENCE", "MEDIUM", "subject", "object")


RULES = [
    "rule_high_value_transfer", "rule_repeated_recipient", "rule_recurring_identifier", "rule_phishing_link", "rule_rapid_sequence", "rule_pre_incident_communication",
    "rule_communication_burst", "rule_recurring_vehicle", "rule_relay_contact", "rule_converging_location", "rule_late_arriving_identity", "rule_vehicle_corridor",
    "rule_sudden_silence", "rule_shared_device",
]
RAISED_SQL = f"WITH {TRANSACTIONS_SQL} SELECT case_id, 'HIGH_VALUE_TRANSFER', id::VARCHAR FROM txns WHERE status = 'F'"


def _every_rule(spark, sf, names):
    found = {n: QUERIES[n](spark, sf).select(F.col("case_id").cast("long").alias("case_id"), "rule", "severity", "key") for n in names}
    raised = rules.high_value(s.transactions(spark, sf).where("status = 'F'"), 0).withColumn("case_id", F.col("case_id").cast("long"))
    relays = found.pop("rule_relay_contact")  # a path each, as good as all alerts of busy contacts
    return rules.evaluate(*found.values(), raised=raised, unique={"RELAY_CONTACT": relays})


@query("evaluate_alerts", "WITH every AS (" + " UNION ".join(f"SELECT case_id::BIGINT AS case_id, rule, severity, key FROM ({ORACLES[n]})" for n in RULES)
       + f"), raised AS (SELECT * FROM ({RAISED_SQL}) AS x(case_id, rule, key)) SELECT every.* FROM every ANTI JOIN raised USING (case_id, rule, key)")
def evaluate_alerts(spark, sf):
    """The fourteen rules that SQL can restate, without alerts already raised."""
    return _every_rule(spark, sf, RULES)


@query("evaluate_alerts_whole")
def evaluate_alerts_whole(spark, sf):
    """All fifteen rules; BRIDGE_ENTITY rests on betweenness and cut nodes, which SQL can't restate."""
    return _every_rule(spark, sf, [*RULES, "rule_bridge_entity"])


@query("list_alerts", f"""
WITH {TRANSACTIONS_SQL} SELECT id, amount, at, row_number() OVER (ORDER BY at DESC, id)::INT AS place FROM txns WHERE amount >= 50000 ORDER BY at DESC, id LIMIT 200
""")  # fmt: skip
def list_alerts(spark, sf):
    """A page of alerts, the newest first."""
    a = s.transactions(spark, sf).where("amount >= 50000").select("id", "amount", "at")
    page = rollups.page(a, [F.desc("at"), F.asc("id")], 200)
    return page.withColumn("place", F.row_number().over(Window.orderBy(F.desc("at"), "id")))


@query("statements", f"""
WITH {RELATIONS_SQL} SELECT id, CASE WHEN id % 9 = 0 AND relation_type <> 'TRANSFERRED_TO' THEN 'Contact is recorded between ' || subject || ' and ' || object || ', without stating who initiated it.'
  WHEN relation_type = 'CALLED' THEN subject || ' called ' || object || '.' WHEN relation_type = 'MESSAGED' THEN subject || ' sent a message to ' || object || '.' ELSE subject || ' sent money to ' || object || '.' END AS statement FROM rels
""")  # fmt: skip
def statements(spark, sf):
    return rules.statements(s.relations(spark, sf).withColumn("directed", F.col("id") % 9 != 0)).select("id", "statement")


@query("sequence_of_events", """
WITH e AS (SELECT user_id, event_id AS id, CASE WHEN event_id % 4 <> 0 THEN ts END AS at, 'event ' || event_id || '.' AS statement FROM events WHERE event_type <> 'view'),
g AS (SELECT *, (epoch_us(at) - epoch_us(lag(at) OVER (PARTITION BY user_id ORDER BY at, id))) / 1e6 AS gap FROM e WHERE at IS NOT NULL),
n AS (SELECT user_id, count(at) AS timed, count(*) FILTER (at IS NULL) AS open FROM e GROUP BY 1),
r AS (
  SELECT user_id, 0 AS part, at, id, 1 AS sub, 'step' AS kind, statement FROM g
  UNION ALL SELECT user_id, 0, at, id, 0, 'gap', 'Then ' || CASE WHEN gap / 3600 < 48 THEN round_even(gap / 3600, 0)::BIGINT || ' hours pass' ELSE round_even(gap / 3600 / 24, 0)::BIGINT || ' days pass' END
    || ' in which no contact between them is recorded. Nothing having been recorded is not the same as nothing having happened.' FROM g WHERE gap >= 21600
  UNION ALL SELECT user_id, 1, NULL, NULL, 0, 'gap', open || CASE WHEN open = 1 THEN ' further record in this pattern carries no established time, so it is' ELSE ' further records in this pattern carry no established time, so they are' END
    || ' listed below rather than placed in the order above.' FROM n WHERE timed > 0 AND open > 0
  UNION ALL SELECT user_id, 2, NULL, id, 1, 'step', statement FROM e WHERE at IS NULL
  UNION ALL SELECT user_id, 3, NULL, NULL, 0, 'closing', 'This is what the sources record, in the order they record it. What it means is a matter for the reader; the system does not draw a conclusion from a sequence.' FROM n
)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY part, at NULLS FIRST, id NULLS FIRST, sub) - 1)::INT AS place, kind, statement FROM r
""")  # fmt: skip
def sequence_of_events(spark, sf):
    """The story of each user: timed steps, gaps, a marker, steps without a time and the closing line."""
    e = s.read(spark, sf, "events").where("event_type <> 'view'")
    steps = e.select("user_id", F.col("event_id").alias("id"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("at"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(".")).alias("statement"))
    return rules.sequence(steps, ["user_id"])


@query("record_places", """
SELECT user_id AS record_id, arg_min(event_type, (ts, event_id)) AS place FROM events WHERE event_type <> 'error' GROUP BY 1
""")  # fmt: skip
def record_places(spark, sf):
    e = s.read(spark, sf, "events")
    return rules.record_places(e.select(F.col("user_id").alias("record_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("place"), F.col("ts").alias("at"), F.col("event_id").alias("id")))


# Integrity


def _sealed(spark, sf):
    o = s.read(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.sha2(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus"), 256).alias("payload"))
    return integrity.append_chain(o, "o_custkey")


SEALED_SQL = """
WITH RECURSIVE o AS (
  SELECT o_custkey, o_orderkey AS id, o_orderdate AS at, sha256(o_orderkey || '|' || o_orderstatus) AS payload, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders
), c AS (
  SELECT o_custkey, id, at, payload, n, NULL::VARCHAR AS previous_hash, sha256('{"payload":"' || payload || '","previous_hash":null}') AS event_hash FROM o WHERE n = 1
  UNION ALL SELECT o.o_custkey, o.id, o.at, o.payload, o.n, c.event_hash, sha256('{"payload":"' || o.payload || '","previous_hash":"' || c.event_hash || '"}') FROM c JOIN o ON o.o_custkey = c.o_custkey AND o.n = c.n + 1
)"""


@query("chain_append", SEALED_SQL + " SELECT o_custkey, id, at, payload, previous_hash, event_hash FROM c")
def chain_append(spark, sf):
    """A chain over each customer's orders, sealed in order."""
    return _sealed(spark, sf)


def _tampered(spark, sf):
    """The sealed chains with contents altered, rows taken out and hashes missing."""
    c = _sealed(spark, sf).where("id % 89 <> 3")
    c = c.withColumn("payload", F.when(F.col("id") % 97 == 5, F.sha2("payload", 256)).otherwise(F.col("payload")))
    return c.withColumn("event_hash", F.when(F.col("id") % 53 != 7, F.col("event_hash")))


TAMPERED_SQL = SEALED_SQL + """, t AS (
  SELECT o_custkey, id, at, CASE WHEN id % 97 = 5 THEN sha256(payload) ELSE payload END AS payload, previous_hash, CASE WHEN id % 53 <> 7 THEN event_hash END AS h FROM c WHERE id % 89 <> 3
), w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY at, id) AS n, lag(h) OVER (PARTITION BY o_custkey ORDER BY at, id) AS before FROM t),
b AS (
  SELECT *, CASE WHEN h IS NOT NULL AND h <> sha256('{"payload":"' || payload || '","previous_hash":' || coalesce('"' || previous_hash || '"', 'null') || '}') THEN 'content_altered'
    WHEN h IS NOT NULL AND (before IS NOT NULL OR (STRICT AND n = 1)) AND before IS DISTINCT FROM previous_hash THEN 'link_broken' END AS bad FROM w
)"""


@query("chain_verify", TAMPERED_SQL.replace("STRICT", "false") + """
SELECT o_custkey, count(*) AS entries, count(h) AS hashed, CASE WHEN count(bad) > 0 THEN 'broken' WHEN count(h) = 0 THEN 'unchained' ELSE 'intact' END AS status,
  arg_min(id, n) FILTER (bad IS NOT NULL) AS first_break, arg_min(bad, n) FILTER (bad IS NOT NULL) AS reason FROM b GROUP BY 1
""")  # fmt: skip
def chain_verify(spark, sf):
    return integrity.verify_chain(_tampered(spark, sf), ["o_custkey"], hashing=integrity.chain_hash).drop("broken_at")


@query("ledger_verify", TAMPERED_SQL.replace("STRICT", "true") + """
SELECT o_custkey, count(*) AS entries, coalesce(min(n) FILTER (bad IS NOT NULL) - 1, count(*)) AS verified, CASE WHEN count(bad) > 0 THEN 'broken' WHEN count(h) = 0 THEN 'unchained' ELSE 'intact' END AS status FROM b GROUP BY 1
""")  # fmt: skip
def ledger_verify(spark, sf):
    return integrity.ledger_verify(_tampered(spark, sf), ["o_custkey"], integrity.chain_hash)


LEDGER_KEY = "shared secret"


def _hmac_sql(message: str, key: str = LEDGER_KEY) -> str:
    raw = key.encode().ljust(64, b"\0")
    pad = lambda x: "'" + "".join(f"\\x{b ^ x:02X}" for b in raw) + "'::BLOB"
    return f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({message}))))"


@query("hmac_digest", f"SELECT c_custkey, {_hmac_sql(chr(39) + 'phone:' + chr(39) + ' || c_name')} AS digest FROM customer")
def hmac_digest(spark, sf):
    return s.read(spark, sf, "customer").select("c_custkey", integrity.hmac_sha256(LEDGER_KEY, F.concat(F.lit("phone:"), "c_name")).alias("digest"))


def _identities(spark, sf):
    """A case's matchable identities in normal form, each once."""
    o = s.shared_occurrences(spark, sf).select("case_id", facts.canonicalize_indicator(F.col("entity_type"), F.col("key")).alias("x"), "evidence_id").where("x IS NOT NULL")
    return o.groupBy(F.col("case_id").alias("case_reference"), "x.entity_type", "x.key").agg(F.min("evidence_id").alias("first"))


IDENTITIES_SQL = f"{s.SHARED_SQL}, i AS (SELECT case_id AS case_reference, entity_type, key, min(evidence_id) AS first FROM occ WHERE entity_type = 'email' GROUP BY 1, 2, 3)"
DIGEST_SQL = _hmac_sql("entity_type || ':' || key")


@query("ledger_identities", f"WITH {IDENTITIES_SQL} SELECT * FROM i")
def ledger_identities(spark, sf):
    return _identities(spark, sf)


EVEN = tuple("02468")


def _ledger(spark, sf):
    """What the even sources have published."""
    none = spark.createDataFrame([], "digest string, case_reference string")
    even = _identities(spark, sf).where(F.right("case_reference", F.lit(1)).isin(*EVEN))
    return integrity.publish(none, even, LEDGER_KEY, "desk", "2024-05-01 00:00:00")


@query("ledger_publish", f"WITH {IDENTITIES_SQL} SELECT {DIGEST_SQL} AS digest, case_reference, 'desk' AS contact, TIMESTAMP '2024-06-01' AS published_at FROM i WHERE right(case_reference, 1) NOT IN {EVEN}")
def ledger_publish(spark, sf):
    """New rows alone: identities of a case that has published them are passed over."""
    return integrity.publish(_ledger(spark, sf), _identities(spark, sf), LEDGER_KEY, "desk", "2024-06-01 00:00:00")


@query("ledger_publish_digests", f"WITH {IDENTITIES_SQL} SELECT {DIGEST_SQL} AS digest, case_reference, 'desk' AS contact FROM i")
def ledger_publish_digests(spark, sf):
    """All that even and odd sources publish between them."""
    first = _ledger(spark, sf)
    return first.unionByName(ledger_publish(spark, sf)).select("digest", "case_reference", "contact")


@query("ledger_withdraw", f"WITH {IDENTITIES_SQL} SELECT {DIGEST_SQL} AS digest, case_reference FROM i WHERE case_reference <> 'src1'")
def ledger_withdraw(spark, sf):
    return integrity.withdraw(ledger_publish_digests(spark, sf), "src1").select("digest", "case_reference")


@query("ledger_match", f"""
WITH {IDENTITIES_SQL} SELECT a.case_reference, a.entity_type, a.key, b.case_reference AS other, 'desk' AS contact FROM i a JOIN i b ON a.entity_type = b.entity_type AND a.key = b.key AND a.case_reference <> b.case_reference
""")  # fmt: skip
def ledger_match(spark, sf):
    none = spark.createDataFrame([], "digest string, case_reference string")
    ids = _identities(spark, sf)
    ledger = integrity.publish(none, ids, LEDGER_KEY, "desk", "2024-05-01 00:00:00")
    return integrity.ledger_matches(ledger, ids.drop("first"), LEDGER_KEY).drop("published_at")


@query("ledger_match_identity", f"""
WITH {IDENTITIES_SQL} SELECT b.case_reference AS other, b.key FROM i b WHERE b.key = (SELECT min(key) FROM i) AND b.case_reference <> 'src0'
""")  # fmt: skip
def ledger_match_identity(spark, sf):
    """Which other cases published one identity of a case."""
    none = spark.createDataFrame([], "digest string, case_reference string")
    ids = _identities(spark, sf)
    ledger = integrity.publish(none, ids, LEDGER_KEY, "desk", "2024-05-01 00:00:00")
    one = ids.agg(F.min(F.struct("key", "entity_type")).alias("x")).select(F.lit("src0").alias("case_reference"), "x.entity_type", "x.key")
    return integrity.ledger_matches(ledger, one, LEDGER_KEY).select("other", "key")


def _leaves(spark, sf):
    d = s.read(spark, sf, "documents").select("source", F.sha2("text", 256).alias("hash"), "doc_id")
    return integrity.placed(d, ["source"], "doc_id").select("source", "place", "hash")


LEAVES_SQL = "l0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, sha256(text) AS h FROM documents), " + ", ".join(f"l{i + 1} AS ({MERKLE.format(of=f'l{i}')})" for i in range(20))


@query("receipt_inclusion", f"""
WITH {LEAVES_SQL}, n AS (SELECT source, count(*) AS set_size FROM l0 GROUP BY 1), w AS (SELECT source, sha256(text) AS hash FROM documents WHERE doc_id % 5 = 0 UNION SELECT DISTINCT source, sha256(source) FROM documents)
SELECT w.source, hash, (SELECT min(p) FROM l0 WHERE l0.source = w.source AND l0.h = w.hash) AS place, set_size, l20.h AS root,
  (SELECT min(p) FROM l0 WHERE l0.source = w.source AND l0.h = w.hash) IS NOT NULL AS verified FROM w JOIN n USING (source) JOIN l20 USING (source)
""")  # fmt: skip
def receipt_inclusion(spark, sf):
    """Proofs that files were in their set, and an answer for hashes that never were."""
    d = s.read(spark, sf, "documents")
    wanted = d.where("doc_id % 5 = 0").select("source", F.sha2("text", 256).alias("hash")).union(d.select("source", F.sha2("source", 256))).distinct()
    return integrity.inclusion_proofs(_leaves(spark, sf), ["source"], wanted)


@query("receipt_manifest", f"""
WITH {LEAVES_SQL}, m AS (SELECT source, count(*) AS n, l20.h AS root FROM documents JOIN l20 USING (source) GROUP BY 1, 3)
SELECT source, root, sha256('{{"case_id":"' || source || '","evidence":' || n || ',"merkle_root":"' || root || '","note":"caf\\u00e9","verification_id":"TRU-' || upper(source) || '-R1"}}') AS manifest_hash FROM m
""")  # fmt: skip
def receipt_manifest(spark, sf):
    """The hash of a receipt's manifest in canonical JSON."""
    n = s.read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    m = integrity.merkle_roots(_leaves(spark, sf), ["source"]).join(n, "source")
    text = integrity.canonical_json({"case_id": F.col("source"), "verification_id": F.concat(F.lit("TRU-"), F.upper("source"), F.lit("-R1")), "merkle_root": F.col("root"), "evidence": (F.col("n").cast("string"),), "note": F.lit("café")})
    return m.select("source", "root", F.sha2(text, 256).alias("manifest_hash"))


@query("snapshot_hash", "WITH d AS (SELECT source, sha256(doc_id || chr(31) || sha256(text)) AS h FROM documents), l0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY h) - 1 AS p, h FROM d), "
       + ", ".join(f"l{i + 1} AS ({MERKLE.format(of=f'l{i}')})" for i in range(20)) + " SELECT source, h AS root FROM l20")
def snapshot_hash(spark, sf):
    d = s.read(spark, sf, "documents").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    return integrity.snapshot_hash(d, ["source"], ["doc_id"], F.col("h"))


# Graphs

_EDGE_ENDS = f"{EDGES_SQL}, b AS (SELECT case_id, u AS node, v AS other FROM edges UNION ALL SELECT case_id, v, u FROM edges)"
LABELS_SQL = "w0 AS (SELECT DISTINCT case_id, node, node AS label FROM b), " + ", ".join(
    f"w{i + 1} AS (SELECT w.case_id, w.node, least(any_value(w.label), min(x.label)) AS label FROM w{i} w JOIN b ON w.case_id = b.case_id AND w.node = b.node JOIN w{i} x ON x.case_id = b.case_id AND x.node = b.other GROUP BY 1, 2)"
    for i in range(12)
)


@query("weakly_connected_components", f"WITH {_EDGE_ENDS}, {LABELS_SQL} SELECT case_id, node, label AS component FROM w12")
def weakly_connected_components(spark, sf):
    return graph.node_components(s.edges(spark, sf), shared_checkpoint(spark))


@query("lineage_metrics", f"""
WITH {_EDGE_ENDS}, {LABELS_SQL}, n AS (SELECT case_id, count(*) AS node_count, count(DISTINCT label) AS components FROM w12 GROUP BY 1)
SELECT case_id, node_count, count(*) AS edge_count, components FROM edges JOIN n USING (case_id) GROUP BY 1, 2, 4
""")  # fmt: skip
def lineage_metrics(spark, sf):
    e = s.edges(spark, sf)
    n = graph.node_components(e, shared_checkpoint(spark)).groupBy("case_id").agg(F.count("*").alias("node_count"), F.count_distinct("component").alias("components"))
    return n.join(e.groupBy("case_id").agg(F.count("*").alias("edge_count")), "case_id")


@query("bfs_levels", f"""
WITH {_EDGE_ENDS}, d AS (SELECT case_id, node, count(*) AS d FROM b GROUP BY 1, 2),
r AS (SELECT case_id, coalesce(max(node) FILTER (node = 'S3'), arg_min(node, (-d, node))) AS node FROM d GROUP BY 1),
f0 AS (SELECT case_id, node, 0 AS level FROM r), """ + ", ".join(
    f"f{i + 1} AS (SELECT case_id, node, min(level) AS level FROM (SELECT * FROM f{i} UNION ALL SELECT b.case_id, b.other, level + 1 FROM f{i} f JOIN b ON f.case_id = b.case_id AND f.node = b.node) GROUP BY 1, 2)" for i in range(10)
) + """, m AS (SELECT case_id, max(level) AS most FROM f10 GROUP BY 1)
SELECT d.case_id, d.node, coalesce(level, most + 1) AS level FROM d LEFT JOIN f10 USING (case_id, node) JOIN m ON d.case_id = m.case_id
""")  # fmt: skip
def bfs_levels(spark, sf):
    """Levels from S3 where a case has it, else from its busiest node; unreached nodes below the deepest."""
    e = s.edges(spark, sf)
    roots = graph.ends(e).where("node = 'S3'").select("case_id", "node").distinct()
    return graph.all_levels(e, roots, shared_checkpoint(spark))


@query("one_hop_filter", f"""
WITH {EDGES_SQL}, x AS (SELECT * FROM edges WHERE list_has_any(string_split(relation_types, ','), ['CALLED'])),
n AS (SELECT case_id, u AS node FROM x WHERE v = 'C2' UNION SELECT case_id, v FROM x WHERE u = 'C2' UNION SELECT case_id, 'C2' FROM x WHERE 'C2' IN (u, v))
SELECT case_id, u, v FROM x WHERE (case_id, u) IN (SELECT (case_id, node) FROM n) AND (case_id, v) IN (SELECT (case_id, node) FROM n)
""")  # fmt: skip
def one_hop_filter(spark, sf):
    return graph.one_hop(s.edges(spark, sf), "C2", ["CALLED"]).select("case_id", "u", "v")


@query("assistant_connection", f"""
WITH {_EDGE_ENDS}, {LABELS_SQL}, direct AS (
  SELECT case_id, string_agg(DISTINCT relation_type, ',' ORDER BY relation_type) AS detail FROM rels WHERE subject = 'C1' AND object = 'S1' AND status <> 'rejected' GROUP BY 1
), c AS (SELECT DISTINCT case_id FROM edges), l AS (SELECT case_id, count(*) AS n, count(DISTINCT label) AS parts FROM w12 WHERE node IN ('C1', 'S1') GROUP BY 1)
SELECT case_id, CASE WHEN direct.detail IS NOT NULL THEN 'direct' WHEN n = 2 AND parts = 1 THEN 'path' ELSE 'none' END AS how FROM c LEFT JOIN direct USING (case_id) LEFT JOIN l USING (case_id)
""")  # fmt: skip
def assistant_connection(spark, sf):
    """How C1 and S1 are joined in each case: directly, by a chain, or not."""
    r = s.relations(spark, sf)
    return graph.connections(s.edges(spark, sf), "C1", "S1", r, shared_checkpoint(spark)).select("case_id", "how")


@query("network_overview", f"""
WITH {EDGES_SQL}, n AS (SELECT case_id, count(DISTINCT node) AS entities FROM (SELECT case_id, u AS node FROM edges UNION ALL SELECT case_id, v FROM edges) GROUP BY 1)
SELECT case_id, entities, count(*) AS relationships, sum(observations)::BIGINT AS observations, 0 AS isolated FROM edges JOIN n USING (case_id) GROUP BY 1, 2
""")  # fmt: skip
def network_overview(spark, sf):
    return graph.overview(s.edges(spark, sf))


@query("network_overview_whole")
def network_overview_whole(spark, sf):
    """With communities and bridges, which SQL can't restate."""
    return graph.whole_overview(s.edges(spark, sf), shared_checkpoint(spark))


@query("important_entities", f"""
WITH {EDGES_SQL}, e AS (SELECT case_id, u AS node, n_evidence, weight FROM edges UNION ALL SELECT case_id, v, n_evidence, weight FROM edges),
d AS (SELECT case_id, node, count(*) AS connections, sum(n_evidence)::BIGINT AS evidence, max(weight) AS best FROM e WHERE node LIKE 'S%' GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY connections DESC, node)::INT AS rank FROM d) WHERE rank <= 10
""")  # fmt: skip
def important_entities(spark, sf):
    """Filtered by type before ranks are given."""
    e = graph.ends(s.edges(spark, sf)).where(F.col("node").startswith("S"))
    d = e.groupBy("case_id", "node").agg(F.count("*").alias("connections"), F.sum("n_evidence").alias("evidence"), F.max("weight").alias("best"))
    return rollups.top_per(d, ["case_id"], [F.desc("connections"), F.asc("node")], 10)


@query("important_entities_whole")
def important_entities_whole(spark, sf):
    """By betweenness, with communities linked and cut nodes."""
    return graph.important(s.edges(spark, sf), shared_checkpoint(spark), "betweenness", F.col("node").startswith("S"))


@query("lineage_graph", """
SELECT 'node' AS part, 'evidence' AS kind, doc_id::VARCHAR AS id, source AS other FROM documents UNION ALL SELECT 'node', 'transaction', o_orderkey::VARCHAR, o_custkey::VARCHAR FROM orders
UNION ALL SELECT 'node', 'event', event_id::VARCHAR, user_id::VARCHAR FROM events UNION ALL SELECT 'node', 'entity', c_custkey::VARCHAR, c_nationkey::VARCHAR FROM customer
UNION ALL SELECT 'edge', 'produced', doc_id::VARCHAR, event_id::VARCHAR FROM events JOIN documents ON user_id = doc_id UNION ALL SELECT 'edge', 'mentioned_in', c_custkey::VARCHAR, event_id::VARCHAR FROM events JOIN customer ON user_id = c_custkey
UNION ALL SELECT 'edge', 'documents', doc_id::VARCHAR, o_orderkey::VARCHAR FROM orders JOIN documents ON o_custkey = doc_id UNION ALL SELECT 'edge', 'records', event_id::VARCHAR, o_orderkey::VARCHAR FROM events JOIN orders ON event_id = o_orderkey
""")  # fmt: skip
def lineage_graph(spark, sf):
    """Nodes with their owner, and the four kinds of edges between evidence, entities, events and transactions."""
    d, o, e, c = (s.read(spark, sf, t) for t in ("documents", "orders", "events", "customer"))
    node = lambda df, i, owner: df.select(F.col(i).alias("id"), F.col(owner).cast("string").alias("owner"))
    edge = lambda df, a, b: df.select(F.col(a).alias("source"), F.col(b).alias("target"))
    nodes = {"evidence": node(d, "doc_id", "source"), "transaction": node(o, "o_orderkey", "o_custkey"), "event": node(e, "event_id", "user_id"), "entity": node(c, "c_custkey", "c_nationkey")}
    ids = d.select("doc_id")
    edges = {
        "produced": edge(e.join(ids, F.col("user_id") == F.col("doc_id")), "doc_id", "event_id"), "mentioned_in": edge(e.join(c, F.col("user_id") == F.col("c_custkey")), "c_custkey", "event_id"),
        "documents": edge(o.join(ids, F.col("o_custkey") == F.col("doc_id")), "doc_id", "o_orderkey"), "records": edge(e.join(o, F.col("event_id") == F.col("o_orderkey")), "event_id", "o_orderkey"),
    }
    return casereads.lineage_graph(nodes, edges)


# Case reads

SEARCH = [
    ("documents", "doc_id", ["source", "lang"]), ("customer", "c_custkey", ["c_name", "c_mktsegment"]), ("events", "event_id", ["event_type"]), ("orders", "o_orderkey", ["o_orderpriority"]),
    ("supplier", "s_suppkey", ["s_name"]), ("part", "p_partkey", ["p_name", "p_brand", "p_type"]),
]
_HITS = " UNION ALL ".join(f"SELECT {i} AS category, {k} AS id FROM {t} WHERE {' OR '.join(f'{c} ILIKE {chr(39)}%r_%{chr(39)}' for c in cs)}" for i, (t, k, cs) in enumerate(SEARCH))


@query("search_case", f"WITH h AS ({_HITS}) SELECT category, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id DESC) AS n FROM h) WHERE n <= 10 ORDER BY category, n LIMIT 60")
def search_case(spark, sf):
    """Six categories in fixed order, newest first, ten of each at most, then the first 60; wildcards of the question stay active."""
    return textindex.search_case([(name, s.read(spark, sf, name), key, cols) for name, key, cols in SEARCH], "r_")


_FOUND = " UNION ALL ".join(f"SELECT {i} AS category, {k} AS id FROM {t} WHERE {' OR '.join(f'{c} ILIKE {chr(39)}%er#00%7%{chr(39)}' for c in cs)}" for i, (t, k, cs) in enumerate(SEARCH))


@query("search_case_indexed", f"WITH h AS ({_FOUND}) SELECT category, id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id DESC) AS n FROM h) WHERE n <= 10 ORDER BY category, n LIMIT 60")
def search_case_indexed(spark, sf):
    """The same with an index of each table's grams, written once: rows without the question's grams aren't compared."""
    tables = [(name, s.read(spark, sf, name), key, cols) for name, key, cols in SEARCH]
    cut = shared_checkpoint(spark)
    return textindex.search_case(tables, "er#00%7", {name: cut(textindex.build(rows, key, cols)) for name, rows, key, cols in tables})


@query("contained_terms", """
WITH n AS (SELECT c_custkey AS id, lower(c_name) AS t FROM customer), q AS (SELECT DISTINCT term FROM (SELECT right(lower(c_name), 4) AS term FROM customer UNION ALL SELECT substr(lower(c_name), 7, 2) FROM customer UNION ALL SELECT 'zz' UNION ALL SELECT 'nobody'))
SELECT term, count(*) AS n, min(id) AS least FROM n JOIN q ON contains(t, term) GROUP BY 1
""")  # fmt: skip
def contained_terms(spark, sf):
    """As many terms as there are customers' endings, each with the names that contain it."""
    c = s.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("t"))
    odd = spark.createDataFrame([("zz",), ("nobody",)], "term string")
    terms = c.select(F.right("t", F.lit(4)).alias("term")).unionByName(c.select(F.substring("t", 7, 2).alias("term"))).unionByName(odd).distinct()
    return textindex.containing(c, terms).groupBy("term").agg(F.count("*").alias("n"), F.min("id").alias("least"))


@query("account_activity", "SELECT event_id, ts, event_type FROM events WHERE user_id = 5 AND event_type = 'view' ORDER BY ts DESC, event_id LIMIT 200")
def account_activity(spark, sf):
    """What a person did outside any case: here views have none."""
    e = s.read(spark, sf, "events").withColumn("case_id", F.when(F.col("event_type") != "view", 0))
    return e.where("user_id = 5 AND case_id IS NULL").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), "event_id").limit(200)


@query("case_acl", f"WITH {CASES_SQL} SELECT 2 AS user_id, case_id FROM cases WHERE owner_id = 2 UNION SELECT 2, c_nationkey FROM customer WHERE c_custkey % 97 = 3 UNION SELECT 9, case_id FROM cases")
def case_acl(spark, sf):
    """User 2 reads what they own or are a member of, administrator 9 everything."""
    cases = s.cases(spark, sf)
    members = s.read(spark, sf, "customer").where("c_custkey % 97 = 3").select(F.col("c_nationkey").alias("case_id"), F.lit(2).alias("user_id"))
    own = joins.visible_cases(cases, members, 2).select(F.lit(2).alias("user_id"), "case_id")
    return own.unionByName(cases.select(F.lit(9).alias("user_id"), "case_id"))


@query("list_notes", """
SELECT conv_id, turn, coalesce(quality::VARCHAR, 'unknown author') AS author, row_number() OVER (ORDER BY conv_id DESC, turn DESC)::INT AS place FROM conversations LEFT JOIN labels ON conv_id = doc_id
WHERE role = 'user' AND conv_id % 11 <> 0 ORDER BY conv_id DESC, turn DESC LIMIT 200
""")  # fmt: skip
def list_notes(spark, sf):
    """The newest notes that aren't deleted (here: of every eleventh subject), with their authors."""
    notes = s.read(spark, sf, "conversations").where("role = 'user' AND conv_id % 11 <> 0").orderBy(F.desc("conv_id"), F.desc("turn")).limit(200)
    people = s.read(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("author"))
    out = joins.lookup_label(notes, "conv_id", people, "doc_id", "author", "unknown author").select("conv_id", "turn", "author")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("conv_id"), F.desc("turn"))))


@query("unique_relations", f"WITH {RELATIONS_SQL} SELECT DISTINCT case_id, relation_type, status AS method, least(subject, object) || ',' || greatest(subject, object) AS fields, evidence_id, round_even(confidence, 2) AS confidence FROM rels")
def unique_relations(spark, sf):
    fields = F.array_join(F.array_sort(F.array("subject", "object")), ",").alias("fields")
    return s.relations(spark, sf).select("case_id", "relation_type", F.col("status").alias("method"), fields, "evidence_id", F.bround("confidence", 2).alias("confidence")).distinct()


CLASSES = ("person", "phone", "email", "ip", "account")


@query("entity_class_counts", f"""
WITH {OCCURRENCES_SQL}, n AS (SELECT entity_type, count(*) AS n FROM (SELECT DISTINCT entity_type, key FROM occ) GROUP BY 1)
SELECT c.entity_type, place, coalesce(n, 0) AS n FROM (SELECT unnest(['person', 'phone', 'email', 'ip', 'account']) AS entity_type, unnest(range(5))::INT AS place) c LEFT JOIN n USING (entity_type)
""")  # fmt: skip
def entity_class_counts(spark, sf):
    """Every class in its fixed order, absent ones with none."""
    n = s.occurrences(spark, sf).select("entity_type", "key").distinct().agg(*(F.count_if(F.col("entity_type") == c).alias(c) for c in CLASSES))
    rows = F.array(*(F.struct(F.lit(c).alias("entity_type"), F.lit(i).alias("place"), F.col(c).alias("n")) for i, c in enumerate(CLASSES)))
    return n.select(F.explode(rows).alias("x")).select("x.*")


COUNTED = ("events", "documents", "orders", "pages", "customer", "conversations")


@query("case_summary_counts", "SELECT * FROM " + ", ".join(f"(SELECT count(*) AS {t} FROM {t})" for t in COUNTED))
def case_summary_counts(spark, sf):
    counts = [s.read(spark, sf, t).agg(F.count("*").alias("n")).withColumn("t", F.lit(t)) for t in COUNTED]
    return reduce(DataFrame.unionByName, counts).agg(*(F.max(F.when(F.col("t") == t, F.col("n"))).alias(t) for t in COUNTED))


FACTS = {"view": "evidence", "click": "relations", "signup": "alerts", "purchase": "reviews", "error": "notes"}


@query("whats_new", "WITH v AS (SELECT user_id, 0 AS case_id, min(ts) + INTERVAL 15 DAY AS since FROM events GROUP BY 1), x AS (SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 4) SELECT case_id, user_id, since, "
       + ", ".join(f"(SELECT count(*) FROM events WHERE ts > since AND event_type = '{k}') AS new_{v}" for k, v in FACTS.items()) + ", coalesce((SELECT string_agg(event_id, ',' ORDER BY ts DESC, event_id) FROM x WHERE ts > since), '') AS examples FROM v")
def whats_new(spark, sf):
    """Five counts a reader, and the newest four notes among those that are new to them."""
    e = s.read(spark, sf, "events")
    visits = e.groupBy("user_id").agg(F.min("ts").alias("t")).select(F.lit(0).alias("case_id"), "user_id", (F.col("t") + F.expr("INTERVAL 15 DAYS")).alias("since"))
    at = lambda kind: e.where(F.col("event_type") == kind).select(F.lit(0).alias("case_id"), F.col("ts").alias("at"))
    out = rollups.whats_new(visits, {name: at(kind) for kind, name in FACTS.items()})
    newest = rollups.top_per(e.where("event_type = 'error'").select(F.lit(0).alias("_c"), "event_id", "ts"), ["_c"], [F.desc("ts"), F.asc("event_id")], 4)
    four = newest.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("rank", "event_id", "ts"))).alias("x"))
    joined = out.join(four, F.col("case_id") == F.col("_c"), "left")
    examples = F.array_join(F.transform(F.filter("x", lambda y: y["ts"] > F.col("since")), lambda y: y["event_id"].cast("string")), ",")
    return joined.select(*out.columns, F.coalesce(examples, F.lit("")).alias("examples"))


@query("timeline_partition", """
SELECT event_type, count(*) FILTER (event_id % 3 = 0) AS dated, count(*) FILTER (event_id % 3 = 1) AS clock_only, count(*) FILTER (event_id % 3 = 2) AS no_time FROM events GROUP BY 1
""")  # fmt: skip
def timeline_partition(spark, sf):
    """By what their words establish: a day, a clock alone, or nothing."""
    from ..functions.moments import find_timestamp

    n = F.col("event_id") % 3
    text = F.when(n == 0, F.date_format("ts", "dd/MM/yyyy HH:mm")).when(n == 1, F.date_format("ts", "h:mm a")).otherwise("later that day")
    e = s.read(spark, sf, "events").select("event_type", find_timestamp(text).alias("t"))
    return e.groupBy("event_type").agg(F.count("t.at").alias("dated"), F.count_if(F.col("t.precision") == "time_only").alias("clock_only"), F.count_if(F.col("t.precision") == "unknown").alias("no_time"))


@query("benchmark_prf", f"""
WITH {OCCURRENCES_SQL}, f AS (SELECT DISTINCT evidence_id AS d, entity_type AS t FROM occ WHERE evidence_id % 10 <> 0 OR entity_type = 'ip'), g AS (SELECT doc_id AS d, 'email' AS t FROM documents WHERE contains(text, '@') UNION ALL SELECT DISTINCT evidence_id, 'ip' FROM occ WHERE entity_type = 'ip' AND evidence_id % 4 <> 0),
n AS (SELECT coalesce(f.t, g.t) AS entity_type, count(*) FILTER (f.d IS NOT NULL AND g.d IS NOT NULL) AS hit, count(g.d) AS want, count(f.d) AS got FROM f FULL JOIN g ON f.d = g.d AND f.t = g.t GROUP BY 1)
SELECT *, round(hit / want, 4) AS recall, CASE WHEN entity_type = 'email' THEN round(hit / got, 4) END AS precision, CASE WHEN entity_type = 'email' THEN round(2.0 * hit / (want + got), 4) END AS f1 FROM n
""")  # fmt: skip
def benchmark_prf(spark, sf):
    """Recall by type; precision and F1 only for types whose truth is exhaustive (here: e-mail)."""
    key = lambda kind: [F.col("evidence_id"), kind.alias("entity_type"), F.lit("").alias("key")]
    occ = s.occurrences(spark, sf)
    found = occ.where("evidence_id % 10 <> 0 OR entity_type = 'ip'").select(*key(F.col("entity_type")))
    mails = s.read(spark, sf, "documents").where(F.col("text").contains("@")).withColumnRenamed("doc_id", "evidence_id")
    truth = mails.select(*key(F.lit("email"))).unionByName(occ.where("entity_type = 'ip' AND evidence_id % 4 <> 0").select(*key(F.lit("ip"))))
    return casereads.benchmark_prf(found, truth, ("email",))


@query("set_class_difference", f"""
WITH {RELATIONS_SQL}, p AS (SELECT c_custkey AS k, c_nationkey AS case_id FROM customer), x AS (SELECT DISTINCT subject FROM rels WHERE status <> 'rejected' AND relation_type = 'CALLED')
SELECT k, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'location' END, CASE WHEN x.subject IS NULL THEN 'person' END, CASE WHEN k % 2 = 0 THEN 'vehicle' END) AS unreached
FROM p LEFT JOIN x ON x.subject = 'C' || k
""")  # fmt: skip
def set_class_difference(spark, sf):
    """Classes that a subject's case holds and no relation reaches, of the four that matter."""
    k = F.col("c_custkey")
    called = s.relations(spark, sf).where("status <> 'rejected' AND relation_type = 'CALLED'").select(F.col("subject").alias("_s")).distinct()
    c = s.read(spark, sf, "customer").join(called, F.concat(F.lit("C"), k.cast("string")) == F.col("_s"), "left")
    present = F.array_compact(F.array(F.lit("person"), F.lit("phone"), F.when(k % 2 == 0, "vehicle"), F.when(k % 3 == 0, "location")))
    subjects = c.select(k.alias("k"), present.alias("present"), F.when(F.col("_s").isNotNull(), F.array(F.lit("person"))).alias("connected"))
    return casereads.unreached_classes(subjects).select("k", "unreached")


@query("network_snapshot", f"""
WITH {EDGES_SQL}, n AS (SELECT case_id, count(DISTINCT node) AS n FROM (SELECT case_id, u AS node FROM edges UNION ALL SELECT case_id, v FROM edges) GROUP BY 1),
c AS (SELECT case_id, count(*) AS contacts, count(DISTINCT evidence_id) AS files, count(*) FILTER (status = 'human_verified') AS verified FROM rels WHERE relation_type IN ('CALLED', 'MESSAGED') AND status <> 'rejected' GROUP BY 1)
SELECT case_id, 'entities' AS measure, n AS value FROM n UNION ALL SELECT case_id, 'relationships', count(*) FROM edges GROUP BY 1 UNION ALL SELECT case_id, 'observations', sum(observations)::BIGINT FROM edges GROUP BY 1
UNION ALL SELECT case_id, 'contacts', contacts FROM c UNION ALL SELECT case_id, 'files', files FROM c UNION ALL SELECT case_id, 'verified', verified FROM c
""")  # fmt: skip
def network_snapshot(spark, sf):
    r = s.relations(spark, sf)
    o = graph.overview(graph.build_edges(r, parts=s.parts(spark, sf, "lineitem"))).unpivot(["case_id"], ["entities", "relationships", "observations"], "measure", "value")
    c = temporal.contacts(r).groupBy("case_id").agg(F.count("*").alias("contacts"), F.count_distinct("evidence_id").alias("files"), F.count_if(F.col("status") == "human_verified").alias("verified"))
    return o.unionByName(c.unpivot(["case_id"], ["contacts", "files", "verified"], "measure", "value"))


@query("case_snapshot", f"""
WITH {TRANSACTIONS_SQL}, {CASES_SQL}, t AS (SELECT case_id, count(*) AS n, count(*) FILTER (amount >= 50000) AS alerts, min(at) AS first_at, max(at) AS last_at FROM txns GROUP BY 1), e AS (SELECT s_nationkey AS case_id, count(*) AS entities FROM supplier GROUP BY 1)
SELECT case_id, case_number, incident_start IS NOT NULL AS window_declared, coalesce(n, 0) AS transactions, coalesce(alerts, 0) AS alerts, coalesce(entities, 0) AS entities, first_at, last_at FROM cases LEFT JOIN t USING (case_id) LEFT JOIN e USING (case_id)
""")  # fmt: skip
def case_snapshot(spark, sf):
    """One row a case: what a report of it starts from."""
    e = s.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("case_id"))
    return casereads.case_snapshot(s.cases(spark, sf), s.transactions(spark, sf), e)


@query("detect_type", """
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'screenshot' WHEN 1 THEN 'pdf' WHEN 2 THEN 'email' WHEN 3 THEN 'cdr' WHEN 4 THEN 'bank_record' WHEN 5 THEN 'fir' WHEN 6 THEN 'email' ELSE 'unknown' END AS source_type,
  CASE o_orderkey % 8 WHEN 0 THEN 'content+category' WHEN 3 THEN 'content+headers' WHEN 4 THEN 'content+headers' WHEN 5 THEN 'category' WHEN 7 THEN 'fallback' ELSE 'content' END AS basis,
  CASE o_orderkey % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'pdf' WHEN 2 THEN 'text' WHEN 3 THEN 'csv' WHEN 4 THEN 'csv' WHEN 5 THEN 'text' WHEN 6 THEN 'text' END AS parser FROM orders
""")  # fmt: skip
def detect_type(spark, sf):
    """Extension, category, header and text of files of eight sorts, with the reader that takes each."""
    n = F.col("o_orderkey") % 8
    pick = lambda *xs: F.get(F.array(*(F.lit(x) if x is not None else F.lit(None).cast("string") for x in xs)), n.cast("int"))
    names = lambda *xs: F.array(*map(F.lit, xs))
    extension = pick("png", "pdf", "eml", "csv", "csv", "txt", "txt", "bin")
    category = pick("whatsapp_screenshot", "email", None, "other", "bank_statement", "complaint_fir", None, None)
    header = F.when(n == 3, names("a_number", "amount")).otherwise(names("date"))
    o = s.read(spark, sf, "orders").select("o_orderkey", files.detect_type(extension, category, header, F.lit("From: a\nbody")).alias("x"), files.parser_of(extension).alias("parser"))
    return o.select("o_orderkey", "x.source_type", "x.basis", "parser")


@query("assistant_at_time", """
SELECT event_id FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%H:%M') WHEN 1 THEN lower(strftime(ts, '%-I:%M %p')) WHEN 2 THEN lower(strftime(ts, '%-I.%M%p')) ELSE strftime(ts, '%H.%M') END AS t FROM events)
WHERE contains(t, '17:30') OR contains(t, '17.30') OR contains(t, '5:30 pm') OR contains(t, '5:30pm') OR contains(t, '5.30 pm') OR contains(t, '5.30pm')
""")  # fmt: skip
def assistant_at_time(spark, sf):
    """Events whose text holds any written form of half past five in the afternoon."""
    n, form = F.col("event_id") % 4, lambda f: F.lower(F.date_format("ts", f))
    text = F.when(n == 0, form("HH:mm")).when(n == 1, form("h:mm a")).when(n == 2, form("h.mma")).otherwise(form("HH.mm"))
    e = s.read(spark, sf, "events").select("event_id", text.alias("t"))
    return e.where(F.exists(scores.written_forms(F.lit("17:30")), lambda w: F.col("t").contains(w))).select("event_id")


@query("entity_summary", f"""
WITH {RELATIONS_SQL}, e AS (SELECT subject AS node, 'subject' AS role, id, relation_type, confidence, evidence_id FROM rels UNION ALL SELECT object, 'object', id, relation_type, confidence, evidence_id FROM rels),
k AS (SELECT node, relation_type, count(*) AS n, row_number() OVER (PARTITION BY node ORDER BY count(*) DESC, relation_type) AS r FROM e GROUP BY 1, 2)
SELECT node, any_value(role) AS roles, count(*) AS relations, count(DISTINCT evidence_id) AS sources, arg_min(id, (-confidence, id)) AS strongest,
  (SELECT string_agg(relation_type, ',' ORDER BY n DESC, relation_type) FROM k WHERE k.node = e.node AND r <= 3) AS kinds FROM e GROUP BY node
""")  # fmt: skip
def entity_summary(spark, sf):
    """All statuses, rejected ones too, as the summary reads them."""
    return casereads.entity_summary(s.relations(spark, sf))


@query("claims", """
SELECT p_partkey AS claim_id, count(l_orderkey) AS sources, count(DISTINCT l_suppkey) AS parties, CASE WHEN count(l_orderkey) = 0 THEN 'unsupported' WHEN bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A') THEN 'contradicted' ELSE 'supported' END AS status
FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1
""")  # fmt: skip
def claims(spark, sf):
    """Claims with their source links; sources that say opposite things contradict."""
    stance = F.when(F.col("l_returnflag") == "R", "supports").when(F.col("l_returnflag") == "A", "opposes")
    links = s.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("claim_id"), F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("party"), stance.alias("stance"))
    return casereads.claims(s.read(spark, sf, "part").select(F.col("p_partkey").alias("claim_id")), links)
