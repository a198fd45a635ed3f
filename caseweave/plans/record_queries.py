"""Rules, integrity, identifiers and resolution over the stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical, identifiers
from ..operators import graph, integrity, resolve, rollups, rules, temporal
from . import standins as s
from .standins import CONTACTS_SQL, OCCURRENCES_SQL, RELATIONS_SQL, TRANSACTIONS_SQL, query
from .temporal_queries import _live


@query("rule_high_value_transfer", f"WITH {TRANSACTIONS_SQL} SELECT case_id, 'HIGH_VALUE_TRANSFER' AS rule, 'HIGH' AS severity, id::VARCHAR AS key FROM txns WHERE amount >= 50000")
def rule_high_value(spark, sf):
    return rules.high_value(s.transactions(spark, sf))


@query("rule_high_value_transfer_450k", f"WITH {TRANSACTIONS_SQL} SELECT case_id, 'HIGH_VALUE_TRANSFER' AS rule, 'HIGH' AS severity, id::VARCHAR AS key FROM txns WHERE amount >= 450000")
def rule_high_value_450k(spark, sf):
    return rules.high_value(s.transactions(spark, sf), 450_000)


@query("rule_repeated_recipient", f"WITH {TRANSACTIONS_SQL} SELECT case_id, 'REPEATED_RECIPIENT' AS rule, 'CRITICAL' AS severity, lower(receiver) AS key FROM txns GROUP BY case_id, lower(receiver) HAVING count(*) >= 2")
def rule_repeated_recipient(spark, sf):
    return rules.repeated_recipient(s.transactions(spark, sf))


@query("rule_recurring_identifier", f"""
WITH {s.SHARED_SQL} SELECT 0 AS case_id, 'RECURRING_IDENTIFIER' AS rule, 'HIGH' AS severity, 'email:' || key AS key FROM occ WHERE entity_type = 'email' GROUP BY key HAVING count(*) >= 3
""")  # fmt: skip
def rule_recurring_identifier(spark, sf):
    return rules.recurring_identifier(s.shared_occurrences(spark, sf).withColumn("case_id", F.lit(0)))


@query("rule_recurring_identifier_occurrences", f"""
WITH {s.SHARED_SQL} SELECT 0 AS case_id, 'RECURRING_IDENTIFIER_OCCURRENCES' AS rule, 'HIGH' AS severity, 'email:' || key AS key FROM occ WHERE entity_type = 'email' GROUP BY key HAVING count(DISTINCT evidence_id) >= 3
""")  # fmt: skip
def rule_recurring_identifier_occurrences(spark, sf):
    return rules.recurring_identifier_occurrences(s.shared_occurrences(spark, sf).withColumn("case_id", F.lit(0)))


@query("rule_phishing_link", """
SELECT DISTINCT user_id AS case_id, 'PHISHING_LINK' AS rule, 'HIGH' AS severity, 'case' AS key FROM events WHERE event_type = 'signup' AND user_id IN (SELECT page_id FROM pages WHERE url LIKE 'https://%')
""")  # fmt: skip
def rule_phishing_link(spark, sf):
    e = s.read(spark, sf, "events").where("event_type = 'signup'").select(F.col("user_id").alias("case_id"), F.lit("phishing_email").alias("event_type"))
    p = s.read(spark, sf, "pages").where(F.col("url").startswith("https://")).select(F.col("page_id").alias("case_id"), F.lit("url").alias("entity_type"))
    return rules.phishing_link(e, p)


@query("rule_rapid_sequence", f"""
WITH {TRANSACTIONS_SQL}, n AS (SELECT case_id, id, at, lag(id) OVER w AS f, lag(at) OVER w AS at1 FROM txns WINDOW w AS (PARTITION BY case_id ORDER BY at, id))
SELECT case_id, 'RAPID_TRANSACTION_SEQUENCE' AS rule, 'MEDIUM' AS severity, f || ':' || id AS key FROM (
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY at1, f) AS k FROM n WHERE epoch_us(at) - epoch_us(at1) <= 5400000000) WHERE k = 1
""")  # fmt: skip
def rule_rapid_sequence(spark, sf):
    return rules.rapid_sequence(temporal.rapid_sequence(s.transactions(spark, sf), ["case_id"]))


@query("rule_recurring_vehicle", """
SELECT c_nationkey AS case_id, 'RECURRING_VEHICLE_AT_LOCATION' AS rule, 'MEDIUM' AS severity, o_custkey || ':' || o_orderpriority AS key
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_custkey, o_orderpriority HAVING count(*) >= 3
""")  # fmt: skip
def rule_recurring_vehicle(spark, sf):
    t = s.transactions(spark, sf)
    return rules.recurring_vehicle(t.select("case_id", F.col("id").alias("record_id"), F.array("sender").alias("vehicles"), F.array("receiver").alias("places")))


@query("rule_bridge_entity")
def rule_bridge_entity(spark, sf):
    from ..operators.lineage import shared_checkpoint

    cut = shared_checkpoint(spark)
    e = cut(s.edges(spark, sf).select("case_id", "u", "v", "distance", "n_evidence"))
    evidence = graph.ends(e.drop("distance")).groupBy("case_id", "node").agg(F.sum("n_evidence").alias("n_evidence"))
    return rules.bridge_entity(graph.node_measures(e, cut), evidence)


@query("rule_relay_contact", f"""
WITH {CONTACTS_SQL}, e AS (SELECT id, at, subject AS m, object AS o FROM contacts WHERE status <> 'rejected' UNION ALL SELECT id, at, object, subject FROM contacts WHERE status <> 'rejected')
SELECT DISTINCT 0 AS case_id, 'RELAY_CONTACT' AS rule, 'MEDIUM' AS severity, concat_ws(':', x.o, x.m, y.o) AS key
FROM e x JOIN e y ON x.m = y.m AND (y.at > x.at OR (y.at = x.at AND y.id > x.id)) AND epoch_us(y.at) - epoch_us(x.at) <= 7200000000 AND x.o <> y.o
""")  # fmt: skip
def rule_relay_contact(spark, sf):
    return rules.pair_rule(temporal.relays(_live(spark, sf)), "RELAY_CONTACT", "MEDIUM", "a", "middle", "b")


def _leaves(spark, sf):
    d = s.read(spark, sf, "documents").select("source", F.sha2("text", 256).alias("hash"), "doc_id")
    return integrity.placed(d, ["source"], "doc_id").select("source", "place", "hash")


MERKLE = "SELECT source, p, CASE WHEN r IS NULL THEN l ELSE sha256(l || r) END AS h FROM (SELECT source, p // 2 AS p, max(h) FILTER (p % 2 = 0) AS l, max(h) FILTER (p % 2 = 1) AS r FROM {of} GROUP BY 1, 2)"


@query("merkle_root", "WITH l0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, sha256(text) AS h FROM documents), "
       + ", ".join(f"l{i + 1} AS ({MERKLE.format(of=f'l{i}')})" for i in range(20)) + " SELECT source, h AS root FROM l20")
def merkle_root(spark, sf):
    return integrity.merkle_roots(_leaves(spark, sf), ["source"])


@query("merkle_proof", "WITH l0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, sha256(text) AS h FROM documents), "
       + ", ".join(f"l{i + 1} AS ({MERKLE.format(of=f'l{i}')})" for i in range(20))
       + " " + " UNION ALL ".join(f"SELECT source, {i} AS level, h AS hash, {bool((5 >> i) & 1)} AS \"left\" FROM l{i} WHERE p = {(5 >> i) ^ 1}" for i in range(20)))
def merkle_proof(spark, sf):
    return integrity.merkle_proof(_leaves(spark, sf), ["source"], 5)


@query("find_email", f"WITH {OCCURRENCES_SQL} SELECT evidence_id AS doc_id, string_agg(key, ',' ORDER BY key) AS emails FROM occ WHERE entity_type = 'email' GROUP BY 1")
def find_email(spark, sf):
    d = s.read(spark, sf, "documents").select("doc_id", F.array_join(identifiers.find_email_addresses(F.col("text")), ",").alias("emails"))
    return d.where("emails <> ''")


@query("find_ip", f"WITH {OCCURRENCES_SQL} SELECT evidence_id AS doc_id, string_agg(key, ',' ORDER BY key) AS addresses FROM occ WHERE entity_type = 'ip' GROUP BY 1")
def find_ip(spark, sf):
    d = s.read(spark, sf, "documents").select("doc_id", F.array_join(identifiers.find_ip_addresses(F.col("text")), ",").alias("addresses"))
    return d.where("addresses <> ''")


@query("find_url", r"""
SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(url || ' ' || html, '(?i)https?://[^\s<>''"]+'))), ' ') AS urls FROM pages
""")  # fmt: skip
def find_url(spark, sf):
    return s.read(spark, sf, "pages").select("page_id", F.array_join(identifiers.find_urls(F.concat_ws(" ", "url", "html")), " ").alias("urls"))


@query("sentences", r"""
SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> ''))::INT AS n FROM documents
""")  # fmt: skip
def sentences(spark, sf):
    return s.read(spark, sf, "documents").select("doc_id", F.size(identifiers.sentences(F.col("text"))).alias("n"))


@query("canonicalize_party", r"""
WITH p AS (SELECT c_custkey, c_name AS v, regexp_replace(c_name, '\D', '', 'g') AS d, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS f FROM customer)
SELECT c_custkey, CASE WHEN length(d) >= 10 THEN 'phone' WHEN regexp_matches(f, '^[a-z]{2,}( [a-z]{2,}){0,3}$') THEN 'person' ELSE 'party' END AS entity_type, CASE WHEN length(d) >= 10 THEN right(d, 10) ELSE f END AS key FROM p
""")  # fmt: skip
def canonicalize_party(spark, sf):
    c = s.read(spark, sf, "customer").select("c_custkey", canonical.canonicalize("sender", F.col("c_name")).alias("x"))
    return c.select("c_custkey", "x.entity_type", "x.key")


@query("merge_key_sha", "SELECT o_orderkey, substr(sha256(concat_ws(chr(31), 'exact', o_custkey, o_orderkey)), 1, 48) AS key FROM orders")
def merge_key_sha(spark, sf):
    o = s.read(spark, sf, "orders")
    return o.select("o_orderkey", F.substring(F.sha2(F.concat_ws("\x1f", F.lit("exact"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")), 256), 1, 48).alias("key"))


def _records(spark, sf):
    d = s.read(spark, sf, "documents")
    t = F.col("text")
    return d.select(
        F.lit(0).alias("case_id"), F.col("doc_id").alias("evidence_id"), F.col("doc_id").alias("record_id"), F.col("doc_id").alias("created_at"),
        identifiers.find_email_addresses(t).alias("email_addresses"), F.concat(F.lit("imei "), "source", F.lit("-device")).alias("device_identifier"),
    )


@query("resolve_entities", f"""
WITH {OCCURRENCES_SQL} SELECT 0 AS case_id, 'email' AS entity_type, key, min(evidence_id) AS first_seen, count(*) AS mentions FROM occ WHERE entity_type = 'email' GROUP BY key
UNION ALL SELECT 0, 'device', regexp_replace(lower('imei ' || source || '-device'), '[^a-z0-9]', '', 'g'), min(doc_id), count(*) FROM documents GROUP BY source
""")  # fmt: skip
def resolve_entities(spark, sf):
    return resolve.entities(resolve.identities(_records(spark, sf))).drop("display")


@query("resolve_occurrences", f"""
WITH {OCCURRENCES_SQL} SELECT 0 AS case_id, 'email' AS entity_type, key, evidence_id, 'email_addresses' AS field FROM occ WHERE entity_type = 'email'
UNION ALL SELECT 0, 'device', regexp_replace(lower('imei ' || source || '-device'), '[^a-z0-9]', '', 'g'), doc_id, 'device_identifier' FROM documents
""")  # fmt: skip
def resolve_occurrences(spark, sf):
    return resolve.occurrences(resolve.identities(_records(spark, sf))).select("case_id", "entity_type", "key", "evidence_id", "field")


@query("co_occurrence_edges", f"""
WITH {OCCURRENCES_SQL}, e AS (
  SELECT evidence_id AS record_id, 'email:' || key AS e FROM occ WHERE entity_type = 'email'
  UNION SELECT doc_id, 'device:' || regexp_replace(lower('imei ' || source || '-device'), '[^a-z0-9]', '', 'g') FROM documents
), n AS (SELECT record_id FROM e GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)
SELECT a.record_id, a.e AS subject, b.e AS object, 'MENTIONED_WITH' AS relation_type, 0.35::DOUBLE AS confidence FROM e a JOIN e b ON a.record_id = b.record_id AND a.e < b.e WHERE a.record_id IN (SELECT record_id FROM n)
""")  # fmt: skip
def co_occurrence_edges(spark, sf):
    return resolve.co_occurrence_edges(resolve.identities(_records(spark, sf))).select("record_id", "subject", "object", "relation_type", "confidence")


@query("stated_party_edges", r"""
SELECT o_orderkey AS record_id, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS subject, trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', ' ', 'g')) AS object,
  CASE WHEN o_orderstatus = 'F' THEN 'CALLED' WHEN o_totalprice > 400000 THEN 'ASSOCIATED_WITH' WHEN o_orderstatus = 'O' THEN 'TRANSFERRED_TO' ELSE 'MESSAGED' END AS relation_type
FROM orders JOIN customer ON o_custkey = c_custkey
""")  # fmt: skip
def stated_party_edges(spark, sf):
    o, c = s.read(spark, sf, "orders"), s.read(spark, sf, "customer")
    source = F.when(F.col("o_orderstatus") == "F", "cdr").when(F.col("o_orderstatus") == "O", "bank_record").otherwise("email")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("case_id"), F.col("o_orderkey").alias("record_id"), F.col("o_orderkey").alias("evidence_id"), F.col("o_orderdate").alias("at"),
        source.alias("source_type"), F.col("c_mktsegment").alias("sender"), F.col("o_orderpriority").alias("receiver"), F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_totalprice") > 400000, "balance").otherwise("unknown").alias("amount_role"),
    )
    return resolve.stated_party_edges(rows).select("record_id", "subject", "object", "relation_type")


@query("sink_upsert", """
SELECT coalesce(c.c_custkey, n.k) AS c_custkey, CASE WHEN c.c_mktsegment = 'BUILDING' OR n.k IS NULL THEN c.c_acctbal ELSE n.b END AS c_acctbal
FROM customer c FULL JOIN (SELECT c_custkey * 2 AS k, c_acctbal + 1 AS b FROM customer) n ON c.c_custkey = n.k
""")  # fmt: skip
def sink_upsert(spark, sf):
    c = s.read(spark, sf, "customer")
    old = c.select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.select((F.col("c_custkey") * 2).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("new").alias("c_mktsegment"))
    return resolve.upsert(old, new, "c_custkey", F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_acctbal")


@query("sink_idempotent_insert", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0)")
def sink_idempotent_insert(spark, sf):
    c, o = s.read(spark, sf, "customer").select("c_custkey"), s.read(spark, sf, "orders").where("o_orderkey % 3 = 0")
    return resolve.insert_new(o.select(F.col("o_custkey").alias("c_custkey")), c.unionByName(c), "c_custkey")


@query("merge_split_entities", """
WITH s AS (SELECT s_nationkey AS case_id, (s_suppkey % 7)::INT AS key, s_suppkey AS id, round(s_acctbal)::BIGINT AS links FROM supplier)
SELECT id, first_value(id) OVER (PARTITION BY case_id, key ORDER BY links DESC, id) AS survivor FROM s
""")  # fmt: skip
def merge_split_entities(spark, sf):
    p = s.read(spark, sf, "supplier")
    rows = p.select(F.col("s_nationkey").alias("case_id"), (F.col("s_suppkey") % 7).alias("key"), F.col("s_suppkey").alias("id"),
                    F.round("s_acctbal").cast("long").alias("links"), F.lit(0).alias("created_at"))
    return resolve.survivors(rows)


@query("entity_profile_connections", f"""
WITH {RELATIONS_SQL}, e AS (SELECT subject AS node, object AS other, confidence, evidence_id FROM rels WHERE status <> 'rejected' UNION ALL SELECT object, subject, confidence, evidence_id FROM rels WHERE status <> 'rejected'),
a AS (SELECT node, other, max(confidence) AS confidence, count(*) AS observations, count(DISTINCT evidence_id) AS n_evidence FROM e GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, observations DESC, other)::INT AS rank FROM a) WHERE rank <= 9
""")  # fmt: skip
def entity_profile_connections(spark, sf):
    n = s.parts(spark, sf, "lineitem")
    a = graph.profile_connections(s.relations(spark, sf).where("status <> 'rejected'"), n)
    # dealt out by party first, so that no task sorts more than its share
    return rollups.top_per(a.repartition(2 * n, "node"), ["node"], [F.desc("confidence"), F.desc("observations"), F.asc("other")], 9)


@query("export_entities", """
SELECT p_partkey, p_name, coalesce(min(l_orderkey)::VARCHAR, 'not in this case') AS file FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1, 2
""")  # fmt: skip
def export_entities(spark, sf):
    p = s.read(spark, sf, "part").select("p_partkey", "p_name")
    f = s.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("_p")).agg(F.min("l_orderkey").cast("string").alias("file"))
    return p.join(f, F.col("p_partkey") == F.col("_p"), "left").select("p_partkey", "p_name", F.coalesce("file", F.lit("not in this case")).alias("file"))
