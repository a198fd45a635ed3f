"""Filters, joins, aggregates, sets and graph reads over the evidence stand-ins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import graph, joins, rollups
from . import standins as s
from .standins import CASES_SQL, EDGES_SQL, OCCURRENCES_SQL, RELATIONS_SQL, TRANSACTIONS_SQL, query


@query("filter_graph_edges", f"WITH {EDGES_SQL.replace('confidence >= 0', 'confidence >= 0.8')} SELECT case_id, u, v, weight, observations, n_evidence, relation_types, 1 / greatest(weight, 0.01) AS distance FROM edges")
def filter_graph_edges(spark, sf):
    return s.edges(spark, sf, min_confidence=0.8)


@query("build_graph_edges", f"WITH {EDGES_SQL} SELECT case_id, u, v, weight, observations, n_evidence, relation_types, 1 / greatest(weight, 0.01) AS distance FROM edges")
def build_graph_edges(spark, sf):
    return s.edges(spark, sf)


@query("filter_entity_relations", f"WITH {RELATIONS_SQL} SELECT id, case_id, subject, object FROM rels WHERE relation_type = 'CALLED' AND status = 'human_verified' AND (subject = 'C7' OR object = 'S7')")
def filter_entity_relations(spark, sf):
    r = s.relations(spark, sf).where("relation_type = 'CALLED' AND status = 'human_verified' AND (subject = 'C7' OR object = 'S7')")
    return r.select("id", "case_id", "subject", "object")


@query("filter_contact", f"WITH {RELATIONS_SQL} SELECT id, case_id, at FROM rels WHERE relation_type IN ('CALLED', 'MESSAGED', 'COMMUNICATED_WITH') AND at IS NOT NULL AND status <> 'rejected'")
def filter_contact(spark, sf):
    from ..operators.temporal import contacts

    return contacts(s.relations(spark, sf)).select("id", "case_id", "at")


@query("page_relations", f"WITH {RELATIONS_SQL} SELECT id, case_id, confidence FROM rels ORDER BY confidence DESC, id LIMIT 50 OFFSET 100")
def page_relations(spark, sf):
    return rollups.page(s.relations(spark, sf).select("id", "case_id", "confidence"), [F.desc("confidence"), F.asc("id")], 50, 100)


@query("page_records", "SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def page_records(spark, sf):
    o = s.read(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    rows = rollups.page(o, [F.desc("o_orderdate"), F.asc("o_orderkey")], 50, 50)
    return rows.withColumn("total", o.agg(F.count("*")).scalar())


@query("page_review_queue", """
SELECT doc_id, band FROM (SELECT doc_id, CASE WHEN quality IS NULL THEN 'unknown' WHEN quality = 1 THEN 'high' ELSE 'low' END AS band
FROM documents LEFT JOIN labels USING (doc_id)) ORDER BY band DESC, doc_id DESC LIMIT 100
""")  # fmt: skip
def page_review_queue(spark, sf):
    d = s.read(spark, sf, "documents").select("doc_id").join(s.read(spark, sf, "labels"), "doc_id", "left")
    rows = d.select("doc_id", scores.band_for(F.col("quality")).alias("band"))
    return rollups.page(rows, [F.desc("band"), F.desc("doc_id")], 100, most=100)


@query("list_transactions", f"WITH {TRANSACTIONS_SQL} SELECT id, case_id, amount, at FROM txns")
def list_transactions(spark, sf):
    return s.transactions(spark, sf).select("id", "case_id", "amount", "at")


@query("list_audit_topk", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 500")
def list_audit_topk(spark, sf):
    return s.read(spark, sf, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), "event_id").limit(500)


SEARCH = [("customer", "c_custkey", ["c_name", "c_mktsegment"]), ("supplier", "s_suppkey", ["s_name"]), ("part", "p_partkey", ["p_name", "p_brand", "p_type"])]


@query("visible_timeline", """
SELECT event_id, ts FROM events e WHERE NOT (event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase'))
""")  # fmt: skip
def visible_timeline(spark, sf):
    """Raw events of a source that also has interpreted ones are left out."""
    e = s.read(spark, sf, "events").select("event_id", "ts", "event_type", "user_id")
    known = e.where("event_type = 'purchase'").select(F.col("user_id").alias("_u")).distinct()
    return e.join(known, (F.col("event_type") == "error") & (F.col("user_id") == F.col("_u")), "left_anti").select("event_id", "ts")


@query("band_for", "SELECT o_orderkey, CASE WHEN c >= 0.85 THEN 'high' WHEN c >= 0.60 THEN 'medium' ELSE 'low' END AS band FROM (SELECT o_orderkey, o_totalprice / 500000 AS c FROM orders)")
def band_for(spark, sf):
    return s.read(spark, sf, "orders").select("o_orderkey", scores.band_for(F.col("o_totalprice") / 500000).alias("band"))


@query("redact", "SELECT doc_id, md5(regexp_replace(text, 'the', 'Protected person A', 'gi')) AS digest FROM documents")
def redact(spark, sf):
    return s.read(spark, sf, "documents").select("doc_id", F.md5(scores.redact(F.col("text"), "the")).alias("digest"))


@query("classify_amount_role", r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(?:closing|available|avl|current|opening)?\s*(?:balance|bal|wallet|holdings?|corpus)\b') THEN 'balance'
  WHEN regexp_matches(text, '(?i)\b(?:paid|sent|debited|credited|transferred|remitted|withdrawn|deposited|received)\b') THEN 'payment'
  WHEN regexp_matches(text, '(?i)\b(?:fees?|charges?|commission|penalty|fine|tax|gst)\b') THEN 'fee'
  WHEN regexp_matches(text, '(?i)\b(?:pay|send|transfer|remit|deposit|requires?|required|needs?|due|payable)\b') THEN 'request' ELSE 'unknown' END AS role
FROM documents
""")  # fmt: skip
def classify_amount_role(spark, sf):
    return s.read(spark, sf, "documents").select("doc_id", scores.classify_amount_role(F.col("text")).alias("role"))


@query("lookup_label", "SELECT o_orderkey, coalesce(c_name, 'unresolved') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def lookup_label(spark, sf):
    c = s.read(spark, sf, "customer").where("c_acctbal > 0")
    return joins.lookup_label(s.read(spark, sf, "orders"), "o_custkey", c, "c_custkey", "c_name", "unresolved").select("o_orderkey", "c_name")


@query("list_cases_left_distinct", """
SELECT DISTINCT n_nationkey, n_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' WHERE n_regionkey = 1 OR c_acctbal > 9000
""")  # fmt: skip
def list_cases_left_distinct(spark, sf):
    m = s.read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_nationkey", "c_acctbal")
    n = s.read(spark, sf, "nation")
    return n.join(m, n.n_nationkey == m.c_nationkey, "left").where("n_regionkey = 1 OR c_acctbal > 9000").select("n_nationkey", "n_name").distinct()


@query("cross_case_hash", """
WITH h AS (SELECT DISTINCT source AS case_id, sha256(text) AS key FROM documents)
SELECT a.case_id, b.case_id AS linked_case, 'file' AS entity_type, a.key FROM h a JOIN h b ON a.key = b.key AND a.case_id <> b.case_id
""")  # fmt: skip
def cross_case_hash(spark, sf):
    d = s.read(spark, sf, "documents")
    return joins.cross_case(d.select(F.col("source").alias("case_id"), F.lit("file").alias("entity_type"), F.sha2("text", 256).alias("key")))


@query("cross_case_reference", """
WITH r AS (SELECT DISTINCT c_nationkey AS case_id, lower(trim(c_mktsegment)) || '-' || (c_custkey % 1000) AS key FROM customer)
SELECT a.case_id, b.case_id AS linked_case, 'reference' AS entity_type, a.key FROM r a JOIN r b ON a.key = b.key AND a.case_id <> b.case_id
""")  # fmt: skip
def cross_case_reference(spark, sf):
    c = s.read(spark, sf, "customer")
    key = F.concat(F.lower(F.trim("c_mktsegment")), F.lit("-"), (F.col("c_custkey") % 1000).cast("string"))
    return joins.cross_case(c.select(F.col("c_nationkey").alias("case_id"), F.lit("reference").alias("entity_type"), key.alias("key")))


@query("isolated_evidence", f"""
WITH {OCCURRENCES_SQL}, b AS (SELECT case_id, entity_type, key FROM occ GROUP BY 1, 2, 3 HAVING count(DISTINCT evidence_id) > 1)
SELECT doc_id AS evidence_id, source AS case_id FROM documents WHERE doc_id NOT IN (SELECT evidence_id FROM occ JOIN b USING (case_id, entity_type, key))
""")  # fmt: skip
def isolated_evidence(spark, sf):
    occ = s.occurrences(spark, sf)
    files = s.read(spark, sf, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("case_id"))
    return rollups.isolated(files, occ, rollups.bridges(occ))


@query("purge_orphans", """
SELECT l_orderkey * 8 + l_linenumber AS txn_id FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0)
""")  # fmt: skip
def purge_orphans(spark, sf):
    o = s.read(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("record_id"))
    records = s.read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("record_id"))
    t = s.read(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("txn_id"), F.col("l_orderkey").alias("event_id"))
    return joins.purge_orphans(o, records, t)[1].select("txn_id")


@query("review_queue_relations", """
SELECT c.conv_id, c.turn, l.quality FROM conversations c JOIN labels l ON list_contains([c.conv_id, c.conv_id + c.turn], l.doc_id)
""")  # fmt: skip
def review_queue_relations(spark, sf):
    """Relations attach to every record that their id list names."""
    c = s.read(spark, sf, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.array(F.col("conv_id"), F.col("conv_id") + F.col("turn")))).alias("record_id"))
    return c.join(s.read(spark, sf, "labels"), F.col("record_id") == F.col("doc_id")).select("conv_id", "turn", "quality")


@query("corr_exact", f"""
WITH {OCCURRENCES_SQL}, v AS (SELECT DISTINCT 0 AS case_id, evidence_id AS record_id, entity_type AS field, key AS value FROM occ)
SELECT a.case_id, a.record_id AS "left", b.record_id AS "right", string_agg(DISTINCT a.field, ',' ORDER BY a.field) AS fields,
  max(CASE WHEN a.field = 'email' THEN 0.8::DOUBLE ELSE 0::DOUBLE END) AS confidence
FROM v a JOIN v b ON a.field = b.field AND a.value = b.value AND a.record_id < b.record_id GROUP BY 1, 2, 3
""")  # fmt: skip
def corr_exact(spark, sf):
    v = s.occurrences(spark, sf).select(
        F.lit(0).alias("case_id"), "evidence_id", F.col("evidence_id").alias("record_id"), F.col("entity_type").alias("field"), F.col("key").alias("value")
    ).distinct()
    return joins.exact_matches(v)


@query("corr_contradiction", f"""
WITH {TRANSACTIONS_SQL}, r AS (SELECT case_id, id, sender || '-' || receiver AS ref, amount, status AS currency, at FROM txns)
SELECT a.case_id, a.id AS "left", b.id AS "right", concat_ws(',', CASE WHEN abs(a.amount - b.amount) > 0.01 THEN 'amount' END,
  CASE WHEN a.currency <> b.currency THEN 'currency' END, CASE WHEN abs(epoch(a.at) - epoch(b.at)) > 86400 THEN 'event_time' END) AS fields, 0.8::DOUBLE AS confidence
FROM r a JOIN r b ON a.case_id = b.case_id AND lower(a.ref) = lower(b.ref) AND a.id < b.id
WHERE abs(a.amount - b.amount) > 0.01 OR a.currency <> b.currency OR abs(epoch(a.at) - epoch(b.at)) > 86400
""")  # fmt: skip
def corr_contradiction(spark, sf):
    t = s.transactions(spark, sf)
    ref = F.concat(F.col("sender").cast("string"), F.lit("-"), "receiver").alias("reference")
    r = t.select("case_id", F.col("id").alias("record_id"), F.col("id").alias("evidence_id"), ref, "amount", F.col("status").alias("currency"), "at")
    return joins.contradictions(r)


@query("relation_summary", f"""
WITH {RELATIONS_SQL} SELECT case_id, relation_type, subject, object, count(*) AS observations, count(DISTINCT evidence_id) AS n_evidence, max(confidence) AS confidence,
  min(at) AS first_at, max(at) AS last_at, CASE WHEN bool_or(status = 'human_verified') THEN 'human_verified' WHEN bool_or(status = 'rejected') THEN 'rejected' ELSE 'machine_extracted' END AS status
FROM rels GROUP BY 1, 2, 3, 4
""")  # fmt: skip
def relation_summary(spark, sf):
    return rollups.relation_summary(s.relations(spark, sf))


STRENGTH = "round_even((CASE entity_type WHEN 'email' THEN 0.88::DOUBLE ELSE 0.6::DOUBLE END) * (0.6::DOUBLE + 0.4::DOUBLE * least(n_evidence, 4) / 4) * greatest(confidence, 0.5), 4)"


@query("bridges_identifiers", f"""
WITH {OCCURRENCES_SQL}, b AS (SELECT case_id, entity_type, key, count(DISTINCT evidence_id) AS n_evidence, count(*) AS occurrences, max(confidence) AS confidence
  FROM (SELECT 'all' AS case_id, evidence_id, entity_type, key, confidence FROM occ) GROUP BY 1, 2, 3 HAVING count(DISTINCT evidence_id) > 1)
SELECT *, {STRENGTH} AS strength, CASE WHEN {STRENGTH} >= 0.85 THEN 'strong' WHEN {STRENGTH} >= 0.6 THEN 'moderate' ELSE 'weak' END AS band FROM b
""")  # fmt: skip
def bridges_identifiers(spark, sf):
    return rollups.bridges(s.occurrences(spark, sf).withColumn("case_id", F.lit("all")))


@query("connection_summary", f"""
WITH {OCCURRENCES_SQL.replace('source AS case_id', "lang AS case_id").replace('SELECT source, doc_id', 'SELECT lang, doc_id')},
b AS (SELECT case_id, entity_type, key, count(DISTINCT evidence_id) AS n_evidence, max(confidence) AS confidence FROM occ GROUP BY 1, 2, 3 HAVING count(DISTINCT evidence_id) > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {STRENGTH} DESC, n_evidence DESC, key, entity_type) AS r FROM b)
SELECT d.lang AS case_id, count(DISTINCT d.doc_id) AS evidence, coalesce(any_value(t.n), 0) AS connected, count(DISTINCT d.doc_id) - coalesce(any_value(t.n), 0) AS isolated,
  coalesce(any_value(x.n), 0) AS bridges, coalesce(any_value(x.s), '') AS strongest
FROM documents d
LEFT JOIN (SELECT case_id, count(DISTINCT evidence_id) AS n FROM occ JOIN b USING (case_id, entity_type, key) GROUP BY 1) t ON t.case_id = d.lang
LEFT JOIN (SELECT case_id, count(*) AS n, string_agg(key, ',' ORDER BY r) FILTER (r <= 5) AS s FROM r GROUP BY 1) x ON x.case_id = d.lang
GROUP BY d.lang
""")  # fmt: skip
def connection_summary(spark, sf):
    d = s.read(spark, sf, "documents").select(F.col("doc_id").alias("evidence_id"), F.col("lang").alias("case_id"))
    occ = s.occurrences(spark, sf).drop("case_id").join(d, "evidence_id")
    return rollups.connection_summary(d, occ)


@query("connection_edges", f"""
WITH {OCCURRENCES_SQL}, o AS (SELECT 'all' AS case_id, entity_type, key, evidence_id FROM occ)
SELECT DISTINCT case_id, entity_type, key, evidence_id FROM o WHERE (entity_type, key) IN (SELECT (entity_type, key) FROM o GROUP BY entity_type, key HAVING count(DISTINCT evidence_id) > 1)
""")  # fmt: skip
def connection_edges(spark, sf):
    return rollups.connection_edges(s.occurrences(spark, sf).withColumn("case_id", F.lit("all")))


@query("across_sources", f"WITH {OCCURRENCES_SQL} SELECT entity_type, key, count(DISTINCT evidence_id) AS n_evidence FROM occ GROUP BY 1, 2 HAVING count(DISTINCT evidence_id) > 1 ORDER BY 3 DESC, key, entity_type LIMIT 10")
def across_sources(spark, sf):
    return rollups.across_sources(s.occurrences(spark, sf))


@query("traceability", "SELECT source AS case_id, count(*) AS total, count(*) FILTER (n_chars > 500) AS traced, round_even(100.0::DOUBLE * count(*) FILTER (n_chars > 500) / count(*), 1) AS percent FROM documents GROUP BY 1")
def traceability(spark, sf):
    return rollups.traceability(s.read(spark, sf, "documents").select(F.col("source").alias("case_id"), "n_chars"), F.col("n_chars") > 500)


@query("txn_strip", f"""
WITH {TRANSACTIONS_SQL} SELECT case_id, count(*) AS n, CASE WHEN count(DISTINCT status) <= 1 THEN sum(amount::DECIMAL(18, 2))::DECIMAL(28, 2) END AS total,
  CASE WHEN count(DISTINCT status) > 1 THEN 'Mixed currencies' ELSE min(status) END AS currency, count(DISTINCT sender) AS senders, count(DISTINCT receiver) AS receivers,
  count(*) FILTER (sender IS NULL OR receiver IS NULL) AS unresolved
FROM txns WHERE case_id % 2 = 0 OR status = 'F' GROUP BY 1
""")  # fmt: skip
def txn_strip(spark, sf):
    t = s.transactions(spark, sf).where("case_id % 2 = 0 OR status = 'F'")
    return rollups.transaction_strip(t.withColumn("currency", F.col("status")))


@query("provider_timing", """
SELECT event_type AS provider, (user_id % 3)::BIGINT AS model, count(*) AS calls, median(latency) AS median, max(latency) AS longest, sum(latency)::BIGINT AS total, count(*) FILTER (cached) AS cached
FROM (SELECT *, (value * 1000)::BIGINT AS latency, event_id % 5 = 0 AS cached FROM events) GROUP BY 1, 2
""")  # fmt: skip
def provider_timing(spark, sf):
    runs = s.read(spark, sf, "events").select(
        F.col("event_type").alias("provider"), (F.col("user_id") % 3).alias("model"), F.round(F.col("value") * 1000).cast("long").alias("latency"), (F.col("event_id") % 5 == 0).alias("cached")
    )
    return rollups.provider_timing(runs)


@query("number_findings", """
SELECT o_orderkey, 'F-' || lpad(n::VARCHAR, 2, '0') AS label FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderdate, o_orderkey) AS n FROM orders)
""")  # fmt: skip
def number_findings(spark, sf):
    o = s.read(spark, sf, "orders")
    order = [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), F.asc("o_orderdate"), F.asc("o_orderkey")]
    ranked = rollups.top_per(o, ["o_custkey"], order, 1 << 30)
    label = F.concat(F.lit("F-"), F.when(F.col("rank") < 10, F.concat(F.lit("0"), F.col("rank").cast("string"))).otherwise(F.col("rank").cast("string")))
    return ranked.select("o_orderkey", label.alias("label"))


@query("topk_entities", f"""
WITH {EDGES_SQL}, d AS (SELECT case_id, node, count(*) AS degree FROM (SELECT case_id, u AS node FROM edges UNION ALL SELECT case_id, v FROM edges) GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY degree DESC, node)::INT AS rank FROM d) WHERE rank <= 10
""")  # fmt: skip
def topk_entities(spark, sf):
    d = graph.degree_centrality(s.edges(spark, sf)).select("case_id", "node", "degree")
    return rollups.top_per(d, ["case_id"], [F.desc("degree"), F.asc("node")], 10)


@query("degree_centrality", f"""
WITH {EDGES_SQL}, d AS (SELECT case_id, node, count(*) AS degree FROM (SELECT case_id, u AS node FROM edges UNION ALL SELECT case_id, v FROM edges) GROUP BY 1, 2)
SELECT *, CASE WHEN count(*) OVER (PARTITION BY case_id) > 1 THEN round_even(degree / (count(*) OVER (PARTITION BY case_id) - 1), 6) ELSE 1.0 END AS centrality FROM d
""")  # fmt: skip
def degree_centrality(spark, sf):
    return graph.degree_centrality(s.edges(spark, sf))


@query("node_weight", f"WITH {EDGES_SQL} SELECT case_id, node, sum(observations)::BIGINT AS weight FROM (SELECT case_id, u AS node, observations FROM edges UNION ALL SELECT case_id, v, observations FROM edges) GROUP BY 1, 2")
def node_weight(spark, sf):
    return graph.node_weight(s.edges(spark, sf))


@query("ego_subgraph", f"""
WITH {EDGES_SQL}, b AS (SELECT case_id, u AS node, v AS other FROM edges UNION ALL SELECT case_id, v, u FROM edges),
n AS (SELECT DISTINCT case_id, node FROM b WHERE node = 'S3' UNION SELECT case_id, other FROM b WHERE node = 'S3')
SELECT e.case_id, u, v, weight, observations FROM edges e WHERE (case_id, u) IN (SELECT (case_id, node) FROM n) AND (case_id, v) IN (SELECT (case_id, node) FROM n)
""")  # fmt: skip
def ego_subgraph(spark, sf):
    return graph.ego_subgraph(s.edges(spark, sf), "S3").select("case_id", "u", "v", "weight", "observations")


@query("node_measures")
def node_measures(spark, sf):
    from ..operators.lineage import shared_checkpoint

    return graph.node_measures(s.edges(spark, sf), shared_checkpoint(spark))


@query("communities")
def communities(spark, sf):
    from ..operators.lineage import shared_checkpoint

    return graph.communities(s.edges(spark, sf), shared_checkpoint(spark))


@query("bridge_edges")
def bridge_edges(spark, sf):
    from ..operators.lineage import shared_checkpoint

    return graph.bridge_edges(s.edges(spark, sf).select("case_id", "u", "v", "weight", "n_evidence"), shared_checkpoint(spark))


_PATHS = ", ".join(
    f"f{i + 1} AS (SELECT case_id, node, min(b) AS b FROM (SELECT * FROM f{i} UNION ALL SELECT b.case_id, b.other, {{'d': f.b.d + b.distance, 'path': list_append(f.b.path, b.other), 'w': least(f.b.w, b.weight)}} FROM f{i} f JOIN b ON f.case_id = b.case_id AND f.node = b.node WHERE NOT list_contains(f.b.path, b.other)) GROUP BY 1, 2)"
    for i in range(10)
)


@query("shortest_path", f"""
WITH {EDGES_SQL}, x AS (SELECT *, 1 / greatest(weight, 0.01) AS distance FROM edges), b AS (SELECT case_id, u AS node, v AS other, distance, weight FROM x UNION ALL SELECT case_id, v, u, distance, weight FROM x),
f0 AS (SELECT DISTINCT case_id, node, {{'d': 0.0::DOUBLE, 'path': [node], 'w': 1.0::DOUBLE}} AS b FROM b WHERE node = 'S1'), {_PATHS},
n AS (SELECT case_id, count(DISTINCT node) AS n FROM b WHERE node IN ('S1', 'S2') GROUP BY 1), e AS (SELECT case_id, b FROM f10 WHERE node = 'S2')
SELECT c.case_id, e.b IS NOT NULL AS found, array_to_string(e.b.path, '>') AS path, round(e.b.d, 6) AS distance, e.b.w AS weakest,
  CASE WHEN coalesce(n, 0) < 2 THEN 'an end has no relations here' WHEN e.b IS NULL THEN 'no chain of relations joins them' END AS reason
FROM (SELECT DISTINCT case_id FROM edges) c LEFT JOIN n USING (case_id) LEFT JOIN e USING (case_id)
""")  # fmt: skip
def shortest_path(spark, sf):
    from ..operators.lineage import shared_checkpoint

    return graph.shortest_path(s.edges(spark, sf), "S1", "S2", shared_checkpoint(spark))


@query("set_union_visible", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_visible(spark, sf):
    c, p = s.read(spark, sf, "customer"), s.read(spark, sf, "supplier")
    return c.select(F.col("c_nationkey").alias("k")).union(p.select("s_nationkey")).distinct()


@query("set_difference_case", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference_case(spark, sf):
    return s.read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(s.read(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("set_intersect_values", "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier")
def set_intersect_values(spark, sf):
    return s.read(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(s.read(spark, sf, "supplier").select("s_suppkey"))


@query("dedupe_first", "SELECT p_brand, arg_min(p_partkey, p_partkey) AS p_partkey FROM part GROUP BY 1")
def dedupe_first(spark, sf):
    return rollups.dedupe_first(s.read(spark, sf, "part").select("p_brand", "p_partkey"), ["p_brand"], ["p_partkey"])


@query("latest_row", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_row(spark, sf):
    return rollups.latest(s.read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
