"""Composite read models and the remaining filters, joins and counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, integrity, joins, records, rollups
from . import standins as s
from .standins import EDGES_SQL, OCCURRENCES_SQL, RELATIONS_SQL, TRANSACTIONS_SQL, query


@query("filter_records", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE source = 'src3' AND quality = 1")
def filter_records(spark, sf):
    return s.read(spark, sf, "documents").where("source = 'src3'").join(s.read(spark, sf, "labels").where("quality = 1"), "doc_id").select("doc_id")


@query("filter_relations", f"WITH {RELATIONS_SQL} SELECT id, case_id FROM rels WHERE relation_type = 'MESSAGED' AND status = 'rejected'")
def filter_relations(spark, sf):
    return s.relations(spark, sf).where("relation_type = 'MESSAGED' AND status = 'rejected'").select("id", "case_id")


@query("page_entity_relations", f"WITH {RELATIONS_SQL} SELECT id, confidence, at FROM rels WHERE subject = 'C1' OR object = 'S1' ORDER BY confidence DESC, at, id LIMIT 100")
def page_entity_relations(spark, sf):
    r = s.relations(spark, sf).where("subject = 'C1' OR object = 'S1'").select("id", "confidence", "at")
    return rollups.page(r, [F.desc("confidence"), F.asc("at"), F.asc("id")], 100, most=500)


@query("join_occurrence_entity", f"WITH {OCCURRENCES_SQL}, e AS (SELECT entity_type, key, min(evidence_id) AS entity_id FROM occ GROUP BY 1, 2) SELECT evidence_id, entity_id FROM occ JOIN e USING (entity_type, key)")
def join_occurrence_entity(spark, sf):
    o = s.occurrences(spark, sf)
    e = o.groupBy("entity_type", "key").agg(F.min("evidence_id").alias("entity_id"))
    return o.join(e, ["entity_type", "key"]).select("evidence_id", "entity_id")


@query("join_event_entity", "SELECT l_orderkey, l_linenumber, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'")
def join_event_entity(spark, sf):
    li, o = s.read(spark, sf, "lineitem"), s.read(spark, sf, "orders").where("o_orderstatus = 'P'")
    return li.join(o, li.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", "o_orderdate")


@query("join_runs_evidence", "SELECT e.event_id, d.source FROM events e JOIN documents d ON e.user_id = d.doc_id ORDER BY e.ts DESC, e.event_id LIMIT 200")
def join_runs_evidence(spark, sf):
    e, d = s.read(spark, sf, "events"), s.read(spark, sf, "documents").select("doc_id", "source")
    return e.join(d, e.user_id == d.doc_id).orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "source")


@query("findings_openable", "SELECT l_orderkey, l_linenumber, o_orderkey IS NOT NULL AS openable FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def findings_openable(spark, sf):
    o = s.read(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    li = s.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left").select("l_orderkey", "l_linenumber", F.col("o_orderkey").isNotNull().alias("openable"))


@query("cross_case_confidence", f"""
WITH {s.SHARED_SQL}, o AS (SELECT case_id, entity_type, key, min(quality) = 1 AS ok FROM occ JOIN labels ON doc_id = evidence_id GROUP BY 1, 2, 3)
SELECT a.case_id, b.case_id AS linked_case, a.key, CASE WHEN a.ok AND b.ok THEN 'high' ELSE 'medium' END AS confidence
FROM o a JOIN o b ON a.entity_type = b.entity_type AND a.key = b.key AND a.case_id <> b.case_id
""")  # fmt: skip
def cross_case_confidence(spark, sf):
    """High where both sides are reviewed."""
    o = s.shared_occurrences(spark, sf).join(s.read(spark, sf, "labels"), F.col("evidence_id") == F.col("doc_id"))
    o = o.groupBy("case_id", "entity_type", "key").agg((F.min("quality") == 1).alias("ok"))
    links = joins.cross_case(o)
    side = lambda c, name: o.select(F.col("case_id").alias(c), "entity_type", "key", F.col("ok").alias(name))
    both = links.join(side("case_id", "x"), ["case_id", "entity_type", "key"]).join(side("linked_case", "y"), ["linked_case", "entity_type", "key"])
    return both.select("case_id", "linked_case", "key", F.when(F.col("x") & F.col("y"), "high").otherwise("medium").alias("confidence"))


@query("alerts_summary", f"""
WITH {TRANSACTIONS_SQL} SELECT case_id, count(*) AS total, count(*) FILTER (status = 'F') AS reviewed, count(*) FILTER (status = 'P') AS dismissed, count(*) FILTER (status = 'O') AS open,
  count(*) FILTER (amount >= 450000) AS high, count(*) FILTER (amount < 450000) AS medium FROM txns WHERE amount >= 50000 GROUP BY 1
""")  # fmt: skip
def alerts_summary(spark, sf):
    a = s.transactions(spark, sf).where("amount >= 50000")
    n = lambda cond, name: F.count_if(F.expr(cond)).alias(name)
    return a.groupBy("case_id").agg(F.count("*").alias("total"), n("status = 'F'", "reviewed"), n("status = 'P'", "dismissed"), n("status = 'O'", "open"), n("amount >= 450000", "high"), n("amount < 450000", "medium"))


@query("balances_list", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '5-LOW' AND o_totalprice IS NOT NULL")
def balances_list(spark, sf):
    return s.read(spark, sf, "orders").where("o_orderpriority = '5-LOW' AND o_totalprice IS NOT NULL").select("o_orderkey", "o_totalprice")


@query("prior_statement_counts", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS convicted, count(*) FILTER (o_orderstatus = 'P') AS closed FROM orders GROUP BY 1")
def prior_statement_counts(spark, sf):
    n = lambda v, name: F.count_if(F.col("o_orderstatus") == v).alias(name)
    return s.read(spark, sf, "orders").groupBy("o_custkey").agg(n("O", "open"), n("F", "convicted"), n("P", "closed"))


@query("focus_graph", f"""
WITH {EDGES_SQL}, e AS (SELECT case_id, u AS node FROM edges UNION ALL SELECT case_id, v FROM edges), d AS (SELECT case_id, node[1] AS kind, node, count(*) AS degree FROM e GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY degree DESC, node)::INT AS rank FROM d) WHERE rank <= CASE WHEN kind = 'C' THEN 4 ELSE 6 END
""")  # fmt: skip
def focus_graph(spark, sf):
    d = graph.ends(s.edges(spark, sf)).groupBy("case_id", F.substring("node", 1, 1).alias("kind"), "node").agg(F.count("*").alias("degree"))
    return rollups.top_per(d, ["case_id", "kind"], [F.desc("degree"), F.asc("node")], 6).where("kind <> 'C' OR rank <= 4")


@query("eigenvector_centrality")
def eigenvector_centrality(spark, sf):
    from ..operators.lineage import shared_checkpoint

    return graph.eigenvector(s.edges(spark, sf), checkpoint=shared_checkpoint(spark))


@query("consecutive_pairs", "SELECT user_id, event_id, nxt FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL")
def consecutive_pairs(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = s.read(spark, sf, "events").select("user_id", "event_id", F.lead("event_id").over(w).alias("nxt"))
    return e.where("nxt IS NOT NULL")


@query("export_relationships", f"""
WITH {RELATIONS_SQL} SELECT id, coalesce(c_name, 'unresolved') AS left_label, coalesce(s_name, 'unresolved') AS right_label FROM rels
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON subject = 'C' || c_custkey LEFT JOIN supplier ON object = 'S' || s_suppkey
""")  # fmt: skip
def export_relationships(spark, sf):
    c = s.read(spark, sf, "customer").where("c_acctbal > 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("k"), F.col("c_name").alias("left_label"))
    p = s.read(spark, sf, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("k"), F.col("s_name").alias("right_label"))
    r = joins.lookup_label(s.relations(spark, sf), "subject", c, "k", "left_label", "unresolved")
    return joins.lookup_label(r, "object", p, "k", "right_label", "unresolved").select("id", "left_label", "right_label")


@query("review_decisions", """
SELECT 'alert' AS subject_type, user_id AS subject_id, arg_max(d, (ts, event_id)) AS decision, CASE WHEN arg_max(d, (ts, event_id)) = 'rejected' THEN 'dismissed' ELSE 'reviewed' END AS status
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'confirmed' END AS d FROM events) GROUP BY 2
""")  # fmt: skip
def review_decisions(spark, sf):
    e = s.read(spark, sf, "events").select(
        F.lit("alert").alias("subject_type"), F.col("user_id").alias("subject_id"), F.when(F.col("event_type") == "error", "rejected").otherwise("confirmed").alias("decision"),
        F.col("ts").alias("at"), F.col("event_id").alias("decision_id"))
    return records.latest_decision(e)


@query("project_events", """
SELECT o_orderkey AS record_id, CASE WHEN o_orderstatus = 'P' THEN 'observed_balance' WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE 'financial_transaction' END AS event_type FROM orders
""")  # fmt: skip
def project_events(spark, sf):
    o = s.read(spark, sf, "orders").select(
        F.lit(0).alias("case_id"), F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderstatus") == "P", "balance").otherwise("payment").alias("amount_role"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("stated_type"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("text"), F.col("o_orderdate").alias("at"))
    return records.project_events(o).select("record_id", "event_type")
