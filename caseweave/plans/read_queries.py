"""Profiles, drafts, questions, read pictures and other case reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import casereads, graph, integrity, ocr, reads, resolve, rollups
from ..operators.lineage import shared_checkpoint
from . import standins as s
from .case_queries import LABELS_SQL, _EDGE_ENDS
from .standins import CASES_SQL, EDGES_SQL, OCCURRENCES_SQL, RELATIONS_SQL, REPORTS_SQL, TRANSACTIONS_SQL, query

# Read pictures


def _words(spark, sf):
    li = s.read(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("image_id"), (n % 3).alias("block_num"), F.lit(0).alias("par_num"), (n % 2).alias("line_num"), n.alias("word_num"),
        F.when(F.col("l_suppkey") % 17 == 0, " ").otherwise(F.concat(F.lit("w"), F.col("l_partkey").cast("string"))).alias("text"),
        (F.col("l_quantity") * 10).cast("double").alias("left"), (n * 40 - 30).cast("double").alias("top"), F.lit(60.0).alias("width"), F.lit(20.0).alias("height"),
        F.when(F.col("l_tax") > 0.06, -1.0).otherwise(F.round(F.col("l_tax") * 1000, 0).cast("double")).alias("conf"),
    )


WORDS_SQL = """words AS (
  SELECT l_orderkey AS image_id, l_linenumber % 3 AS block_num, 0 AS par_num, l_linenumber % 2 AS line_num, l_linenumber AS word_num, CASE WHEN l_suppkey % 17 = 0 THEN ' ' ELSE 'w' || l_partkey END AS text,
    (l_quantity * 10)::DOUBLE AS "left", (l_linenumber * 40 - 30)::DOUBLE AS top, 60.0::DOUBLE AS width, 20.0::DOUBLE AS height, CASE WHEN l_tax > 0.06 THEN -1.0 ELSE round(l_tax * 1000, 0)::DOUBLE END AS conf FROM lineitem
), blocks AS (
  SELECT image_id, block_num, par_num, line_num, string_agg(trim(text), ' ' ORDER BY word_num, "left", trim(text)) AS text, coalesce(avg(conf) FILTER (conf >= 0), 0) AS confidence,
    sum(conf) FILTER (conf >= 0) AS conf_sum, count(*) FILTER (conf >= 0) AS conf_n, min("left") AS "left", min(top) AS top, max("left" + width) AS "right", max(top + height) AS bottom
  FROM words WHERE trim(text) <> '' GROUP BY 1, 2, 3, 4
)"""


def _images(spark, sf):
    return s.read(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(600.0).alias("width"), F.lit(260.0).alias("height"))


@query("ocr_line_blocks", f'WITH {WORDS_SQL} SELECT image_id, block_num, par_num, line_num, text, round(confidence, 6) AS confidence, "left", top, "right", bottom FROM blocks')
def ocr_line_blocks(spark, sf):
    return ocr.line_blocks(_words(spark, sf)).drop("conf_sum", "conf_n").withColumn("confidence", F.round("confidence", 6))


@query("ocr_quality_flags", f"""
WITH {WORDS_SQL}, n AS (SELECT image_id, count(*) AS n, sum(conf_sum) / sum(conf_n) AS mean, count(*) FILTER (confidence < 30) AS poor, max(bottom) AS bottom, min(top) AS top FROM blocks GROUP BY 1)
SELECT o_orderkey AS image_id, concat_ws(',', CASE WHEN mean < 55 THEN 'blurry' END, CASE WHEN bottom >= 258 OR top <= 1 THEN 'cropped' END, CASE WHEN n IS NULL THEN 'incomplete' END, CASE WHEN poor > n / 3 THEN 'low_quality' END) AS flags
FROM orders LEFT JOIN n ON image_id = o_orderkey
""")  # fmt: skip
def ocr_quality_flags(spark, sf):
    out = ocr.quality_flags(_images(spark, sf), ocr.line_blocks(_words(spark, sf)))
    return out.select("image_id", F.array_join("flags", ",").alias("flags"))


@query("ocr_directions", f"""
WITH {WORDS_SQL} SELECT image_id, block_num, par_num, line_num, CASE WHEN "left" / 600 + 0.12 <= 1 - "right" / 600 THEN 'incoming' WHEN 1 - "right" / 600 + 0.12 <= "left" / 600 THEN 'outgoing' END AS direction
FROM blocks JOIN orders ON image_id = o_orderkey WHERE top > 260 * 0.14
""")  # fmt: skip
def ocr_directions(spark, sf):
    return ocr.directions(_images(spark, sf), ocr.line_blocks(_words(spark, sf))).select(*ocr.LINE, "direction")


@query("ocr_header_identifiers", """
SELECT c_custkey AS image_id, CASE c_custkey % 4 WHEN 0 THEN (9000000000 + c_custkey)::VARCHAR WHEN 1 THEN 'Asha Rao' WHEN 2 THEN '4919' || (10000000 + c_custkey) END AS identifier FROM customer WHERE c_custkey % 4 <> 3
""")  # fmt: skip
def ocr_header_identifiers(spark, sf):
    """Headers that show a number, a name, a garbled number, or a screen's label alone."""
    k, n = F.col("c_custkey"), F.col("c_custkey") % 4
    text = F.when(n == 0, F.concat(F.lit("call "), (k + 9_000_000_000).cast("string"))).when(n == 1, "Asha Rao").when(n == 2, F.concat(F.lit("4919"), (k + 10_000_000).cast("string"))).otherwise("Chats:")
    c = s.read(spark, sf, "customer")
    line = lambda i, t: F.struct(F.lit(i).alias("block_num"), F.lit(0).alias("par_num"), F.lit(0).alias("line_num"), t.alias("text"), F.lit(5.0 * i).alias("top"))
    blocks = c.select(k.alias("image_id"), F.explode(F.array(line(1, F.lit("= L) e")), line(2, F.lit("WhatsApp")), line(3, text), line(30, F.lit("Body Text")))).alias("x")).select("image_id", "x.*")
    return ocr.header_identifiers(c.select(k.alias("image_id"), F.lit(260.0).alias("height")), blocks)


# Connections and graphs in words


@query("describe_connections", f"""
WITH {OCCURRENCES_SQL}, b AS (SELECT entity_type, key, count(DISTINCT evidence_id) AS n, string_agg(DISTINCT 'file ' || evidence_id, ', ' ORDER BY 'file ' || evidence_id) AS names FROM occ GROUP BY 1, 2 HAVING count(DISTINCT evidence_id) > 1)
SELECT entity_type, key, 'The ' || CASE entity_type WHEN 'email' THEN 'email address' ELSE entity_type END || ' ' || key || ' appears in ' || n || ' evidence items: ' || names || '.' AS sentence,
  'This is an exact identifier match. It links the files, not the people behind them.' AS caveat FROM b
""")  # fmt: skip
def describe_connections(spark, sf):
    occ = s.occurrences(spark, sf).withColumn("case_id", F.lit(0))
    files = occ.select("case_id", "entity_type", "key", F.concat(F.lit("file "), F.col("evidence_id").cast("string")).alias("name"))
    return reads.describe(rollups.bridges(occ), files).select("entity_type", "key", "sentence", "caveat")


@query("connection_edges_dashed", """
WITH r AS (SELECT o_custkey AS relation_id, list_sort(list_distinct(list(o_orderkey))) AS e FROM orders GROUP BY 1), p AS (SELECT relation_id, e, unnest(range(1, len(e))) AS i FROM r WHERE len(e) > 1)
SELECT relation_id, e[i] AS "left", e[i + 1] AS "right" FROM p
""")  # fmt: skip
def connection_edges_dashed(spark, sf):
    r = s.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("relation_id")).agg(F.array_sort(F.collect_set("o_orderkey")).alias("evidence"))
    return reads.dashed_edges(r)


@query("ego_subgraph_cut", f"""
WITH {EDGES_SQL}, b AS (SELECT case_id, u AS node, v AS other FROM edges UNION ALL SELECT case_id, v, u FROM edges),
n AS (SELECT DISTINCT case_id, node FROM b WHERE node = 'S3' UNION SELECT case_id, other FROM b WHERE node = 'S3'),
x AS (SELECT e.case_id, u, v, row_number() OVER (PARTITION BY e.case_id ORDER BY weight DESC, u, v) AS r, count(*) OVER (PARTITION BY e.case_id) AS m FROM edges e WHERE (case_id, u) IN (SELECT (case_id, node) FROM n) AND (case_id, v) IN (SELECT (case_id, node) FROM n))
SELECT case_id, u, v, m > 40 AS truncated FROM x WHERE r <= 40
""")  # fmt: skip
def ego_subgraph_cut(spark, sf):
    """At most 40 edges a case, the surest first, and whether there were more."""
    e = graph.ego_subgraph(s.edges(spark, sf), "S3")
    n = e.groupBy(F.col("case_id").alias("_c")).agg((F.count("*") > 40).alias("truncated"))
    top = rollups.top_per(e, ["case_id"], [F.desc("weight"), F.asc("u"), F.asc("v")], 40)
    return top.join(n, F.col("case_id") == F.col("_c")).select("case_id", "u", "v", "truncated")


@query("focus_graph_parts", f"""
WITH {RELATIONS_SQL}, x AS (
  SELECT case_id, 'event' AS kind, relation_type || ' ' || at::DATE AS label, count(*) AS degree FROM rels WHERE status <> 'rejected' GROUP BY 1, 3 HAVING count(*) >= 2
  UNION ALL SELECT case_id, 'transaction', 'txn ' || evidence_id, count(*) FROM rels WHERE status <> 'rejected' AND relation_type = 'TRANSFERRED_TO' GROUP BY 1, 3
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, kind ORDER BY degree DESC, label)::INT AS rank FROM x) WHERE rank <= CASE kind WHEN 'event' THEN 3 ELSE 6 END
""")  # fmt: skip
def focus_graph_parts(spark, sf):
    """The three busiest events of two relations or more, and the six busiest transactions, of each case."""
    r = s.relations(spark, sf).where("status <> 'rejected'")
    day = F.concat_ws(" ", "relation_type", F.col("at").cast("date").cast("string"))
    events = r.groupBy("case_id", F.lit("event").alias("kind"), day.alias("label")).agg(F.count("*").alias("degree")).where("degree >= 2")
    money = r.where("relation_type = 'TRANSFERRED_TO'").groupBy("case_id", F.lit("transaction").alias("kind"), F.concat(F.lit("txn "), F.col("evidence_id").cast("string")).alias("label")).agg(F.count("*").alias("degree"))
    return rollups.top_per(events.unionByName(money), ["case_id", "kind"], [F.desc("degree"), F.asc("label")], 6).where("kind <> 'event' OR rank <= 3")


@query("requisition_draft")
def requisition_draft(spark, sf):
    """With the load-bearing ends first; which edges those are, SQL can't restate (see requisition_draft_plain)."""
    r = s.relations(spark, sf)
    return reads.requisitions(r, graph.bridge_edges(s.edges(spark, sf).select("case_id", "u", "v"), shared_checkpoint(spark)))


@query("requisition_draft_plain", f"""
WITH {RELATIONS_SQL}, e AS (SELECT case_id, subject AS node, relation_type, at, evidence_id FROM rels UNION ALL SELECT case_id, object, relation_type, at, evidence_id FROM rels),
f AS (SELECT DISTINCT case_id, unnest([subject, object]) AS node FROM rels WHERE id % 101 = 7),
a AS (SELECT e.case_id, e.node, count(*) AS observations, string_agg(DISTINCT lower(replace(relation_type, '_', ' ')), ', ' ORDER BY lower(replace(relation_type, '_', ' '))) AS kinds, count(DISTINCT evidence_id) AS n_evidence,
  (min(at) - INTERVAL 2 DAY)::DATE AS from_day, (max(at) + INTERVAL 2 DAY)::DATE AS to_day, any_value(f.node) IS NOT NULL AS load_bearing FROM e LEFT JOIN f ON f.case_id = e.case_id AND f.node = e.node GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY load_bearing DESC, n_evidence DESC, node)::INT AS rank FROM a) WHERE rank <= 12
""")  # fmt: skip
def requisition_draft_plain(spark, sf):
    """The same with a given set of fragile relations."""
    r = s.relations(spark, sf)
    return reads.requisitions(r, r.where("id % 101 = 7").select("case_id", F.col("subject").alias("u"), F.col("object").alias("v")))


@query("related_rollup", f"""
WITH {EDGES_SQL}, e AS (SELECT u AS node, v AS other, relation_types, observations FROM edges UNION ALL SELECT v, u, relation_types, observations FROM edges),
a AS (SELECT node, other, sum(observations)::BIGINT AS observations, list_sort(list_distinct(flatten(list(string_split(relation_types, ','))))) AS k FROM e GROUP BY 1, 2)
SELECT node, other, observations, array_to_string(k, ',') AS kinds, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY observations DESC, other)::INT AS rank FROM a) WHERE rank <= 9
""")  # fmt: skip
def related_rollup(spark, sf):
    e = graph.ends(s.edges(spark, sf))
    a = e.groupBy("node", "other").agg(F.sum("observations").alias("observations"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("relation_types", ","))))), ",").alias("kinds"))
    return rollups.top_per(a, ["node"], [F.desc("observations"), F.asc("other")], 9)


# Profiles


@query("entity_profile_aliases", """
WITH a AS (SELECT l_suppkey AS entity, CASE WHEN l_linenumber % 2 = 0 THEN upper(l_returnflag) ELSE lower(l_returnflag) END AS value, l_shipdate AS at, l_orderkey * 8 + l_linenumber AS id FROM lineitem)
SELECT entity, arg_min(value, (at, id, value)) AS alias, count(*) AS n FROM a GROUP BY entity, lower(value)
""")  # fmt: skip
def entity_profile_aliases(spark, sf):
    """Written forms of an entity, without case, the first of each."""
    n = F.col("l_linenumber")
    a = s.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entity"), F.when(n % 2 == 0, F.upper("l_returnflag")).otherwise(F.lower("l_returnflag")).alias("value"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 8 + n).alias("id"))
    return a.groupBy("entity", F.lower("value").alias("_f")).agg(F.min_by("value", F.struct("at", "id", "value")).alias("alias"), F.count("*").alias("n")).drop("_f")


@query("entity_profile_appearances", f"""
WITH {RELATIONS_SQL}, e AS (SELECT subject AS node, evidence_id, at FROM rels UNION ALL SELECT object, evidence_id, at FROM rels)
SELECT node, evidence_id, count(*) AS times, min(at) AS first_at FROM e GROUP BY 1, 2
""")  # fmt: skip
def entity_profile_appearances(spark, sf):
    e = s.relations(spark, sf).select(F.explode(F.array("subject", "object")).alias("node"), "evidence_id", "at")
    return e.groupBy("node", "evidence_id").agg(F.count("*").alias("times"), F.min("at").alias("first_at"))


@query("entity_profile_timeline", f"""
WITH {RELATIONS_SQL}, {TRANSACTIONS_SQL}
SELECT 'C' || sender AS node, at, 'record' AS kind, id FROM txns UNION ALL SELECT subject, at, 'relation', id FROM rels WHERE status <> 'rejected'
""")  # fmt: skip
def entity_profile_timeline(spark, sf):
    """Relations and records of an entity together; a reader orders by time."""
    t = s.transactions(spark, sf).select(F.concat(F.lit("C"), F.col("sender").cast("string")).alias("node"), "at", F.lit("record").alias("kind"), "id")
    r = s.relations(spark, sf).where("status <> 'rejected'").select(F.col("subject").alias("node"), "at", F.lit("relation").alias("kind"), "id")
    return t.unionByName(r)


@query("profile_other_cases", f"""
WITH {OCCURRENCES_SQL}, o AS (SELECT DISTINCT case_id, entity_type, key FROM occ WHERE case_id <> 'src1')
SELECT entity_type, key, count(*) AS n_cases, string_agg(case_id, ',' ORDER BY case_id) AS cases FROM o GROUP BY 1, 2 HAVING count(*) > 1
""")  # fmt: skip
def profile_other_cases(spark, sf):
    """Among the cases that the reader may see; src1 is closed to them."""
    o = s.occurrences(spark, sf)
    return casereads.profile_other_cases(o, o.select("case_id").distinct().where("case_id <> 'src1'"))


# Reports


@query("court_annexure", """
SELECT source AS case_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS place, doc_id AS evidence_id, sha256(text) AS sha256, n_chars, CASE WHEN quality IS NULL THEN 'received' ELSE 'processed' END AS state
FROM documents LEFT JOIN labels USING (doc_id)
""")  # fmt: skip
def court_annexure(spark, sf):
    """The register of evidence: what exists, what it hashes to, how far it was handled; no reading of it."""
    d = s.read(spark, sf, "documents").select("doc_id", F.col("source").alias("case_id"), F.sha2("text", 256).alias("sha256"), "n_chars").join(s.read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = integrity.placed(d, ["case_id"], "doc_id")
    return rows.select("case_id", (F.col("place") + 1).cast("int").alias("place"), F.col("doc_id").alias("evidence_id"), "sha256", "n_chars", F.when(F.col("quality").isNull(), "received").otherwise("processed").alias("state"))


@query("handover", f"""
WITH {TRANSACTIONS_SQL}, {CASES_SQL} SELECT case_id, count(id) AS findings, count(*) FILTER (status = 'F') AS confirmed, count(*) FILTER (status = 'O') AS open_leads, min(id) FILTER (status = 'P') AS next_unchecked FROM cases LEFT JOIN txns USING (case_id) GROUP BY 1
""")  # fmt: skip
def handover(spark, sf):
    """Where a case was left: what is confirmed, what is open, what comes next."""
    t = s.transactions(spark, sf)
    n = lambda v, name: F.count_if(F.coalesce(F.col("status") == v, F.lit(False))).alias(name)
    return s.cases(spark, sf).select("case_id").join(t, "case_id", "left").groupBy("case_id").agg(F.count("id").alias("findings"), n("F", "confirmed"), n("O", "open_leads"), F.min(F.when(F.col("status") == "P", F.col("id"))).alias("next_unchecked"))


TOPS = {"ranked": 3, "fragile": 5, "pre_incident": 6, "bursts": 6, "findings": 40, "across_sources": 10, "strongest": 5, "described": 8, "lines": 6}


@query("topk_named", f"""
WITH {TRANSACTIONS_SQL}, k AS (SELECT unnest([{', '.join(f"'{t}'" for t in TOPS)}]) AS section, unnest([{', '.join(map(str, TOPS.values()))}]) AS most)
SELECT section, case_id, id, rank FROM (SELECT case_id, id, row_number() OVER (PARTITION BY case_id ORDER BY amount DESC, id)::INT AS rank FROM txns) JOIN k ON rank <= most
""")  # fmt: skip
def topk_named(spark, sf):
    """The named sections of a report, each with its own length, from one ranking."""
    best = rollups.top_per(s.transactions(spark, sf).select("case_id", "id", "amount"), ["case_id"], [F.desc("amount"), F.asc("id")], max(TOPS.values()))
    sections = F.explode(F.array(*(F.struct(F.lit(k).alias("section"), F.lit(v).alias("most")) for k, v in TOPS.items())))
    return best.select("case_id", "id", "rank", sections.alias("x")).where("rank <= x.most").select("x.section", "case_id", "id", "rank")


@query("export_findings", """
WITH v AS (SELECT o_custkey AS case_id, o_orderkey % 3 AS version, o_orderkey AS finding FROM orders WHERE o_orderstatus <> 'P'), l AS (SELECT case_id, max(version) AS version FROM v GROUP BY 1)
SELECT case_id, version, finding, 'statement ' || finding AS statement FROM v JOIN l USING (case_id, version)
""")  # fmt: skip
def export_findings(spark, sf):
    """The findings in the JSON of each case's latest report version, one row each."""
    o = s.read(spark, sf, "orders").where("o_orderstatus <> 'P'")
    one = F.struct(F.col("o_orderkey").alias("finding"), F.concat(F.lit("statement "), F.col("o_orderkey").cast("string")).alias("statement"))
    reports = o.groupBy(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 3).alias("version")).agg(F.to_json(F.collect_list(one)).alias("findings"))
    return casereads.export_findings(reports, "struct<finding:long,statement:string>")


@query("redact_nested", """
SELECT doc_id, md5(concat_ws('|', regexp_replace(source, 'src1', 'Protected person A', 'gi'), regexp_replace(lang, 'src1', 'Protected person A', 'gi'), regexp_replace(upper(source), 'src1', 'Protected person A', 'gi'), 'note ' || regexp_replace(source, 'src1', 'Protected person A', 'gi'))) AS digest FROM documents
""")  # fmt: skip
def redact_nested(spark, sf):
    """The alias gone from strings, arrays, maps and structures alike."""
    d = s.read(spark, sf, "documents").select("doc_id", "source", F.array("lang", F.upper("source")).alias("xs"), F.create_map(F.lit("k"), F.struct(F.concat(F.lit("note "), "source").alias("t"))).alias("m"))
    out = reads.redact_frame(d, "src1")
    return out.select("doc_id", F.md5(F.concat_ws("|", "source", F.get("xs", F.lit(0)), F.get("xs", F.lit(1)), F.try_element_at("m", F.lit("k"))["t"])).alias("digest"))


@query("sink_artifacts", """
SELECT DISTINCT o_custkey AS evidence_id, o_orderkey % 2 AS version, o_orderstatus AS layer FROM orders WHERE (o_custkey, o_orderkey % 2, o_orderstatus) NOT IN (SELECT (c_custkey, 0, 'F') FROM customer)
""")  # fmt: skip
def sink_artifacts(spark, sf):
    """Raw layers that are not stored yet, one for each evidence, version and layer."""
    key = ["evidence_id", "version", "layer"]
    new = s.read(spark, sf, "orders").select(F.col("o_custkey").alias("evidence_id"), (F.col("o_orderkey") % 2).alias("version"), F.col("o_orderstatus").alias("layer"))
    stored = s.read(spark, sf, "customer").select(F.col("c_custkey").alias("evidence_id"), F.lit(0).cast("long").alias("version"), F.lit("F").alias("layer"))
    return new.join(stored, key, "left_anti").dropDuplicates(key)


@query("trustify_summary", """
WITH a AS (SELECT 'src' || (user_id % 10) AS source, count(*) AS audit, max(event_id) FILTER (event_type = 'purchase') AS receipt, count(*) FILTER (event_type = 'purchase') AS receipts FROM events GROUP BY 1)
SELECT source, count(*) AS evidence, count(text) AS hashes, max(doc_id) AS latest, arg_max(sha256(text), doc_id) AS head, coalesce(any_value(audit), 0) AS audit, coalesce(any_value(receipts), 0) AS receipts, any_value(receipt) AS latest_receipt FROM documents LEFT JOIN a USING (source) GROUP BY 1
""")  # fmt: skip
def trustify_summary(spark, sf):
    case_of = F.concat(F.lit("src"), (F.col("user_id") % 10).cast("string"))
    audit = s.read(spark, sf, "events").select(case_of.alias("case_id"), F.col("event_id").alias("audit_id"), (F.col("event_type") == "purchase").alias("is_receipt"))
    evidence = s.read(spark, sf, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("evidence_id"), F.sha2("text", 256).alias("sha256"))
    return casereads.trustify_summary(evidence, audit).withColumnRenamed("case_id", "source")


@query("case_health", f"""
WITH {TRANSACTIONS_SQL}, x AS (SELECT case_id, count(*) AS contradictions FROM (SELECT case_id, sender, receiver FROM txns GROUP BY 1, 2, 3 HAVING count(DISTINCT status) > 1) GROUP BY 1)
SELECT case_id, count(*) FILTER (status = 'F') AS completed, count(*) FILTER (status = 'P') AS failed, count(*) FILTER (amount >= 450000 AND status = 'O') AS open_alerts,
  count(*) FILTER (at IS NULL) AS untimed, coalesce(any_value(contradictions), 0) AS contradictions FROM txns LEFT JOIN x USING (case_id) GROUP BY 1
""")  # fmt: skip
def case_health(spark, sf):
    return casereads.case_health(s.transactions(spark, sf), 450_000)


# Questions

QUESTIONS = ["What happened at 21:45?", "How are A and B connected?", "Is there a link here?", "Who is the most central person?", "When was the burst?", "Any unusual pattern?", "Which file is it?", "Tell me about A", "A and B", "A", "Hello"]
INTENTS = ["time", "connection", "overview", "importance", "chronology", "alerts", "evidence", "entity", "connection", "entity", "overview"]
MATCHED = [0, 2, 1, 1, 0, 0, 0, 1, 2, 1, 0]
INTENTS[2] = "entity"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


@query("assistant_ask", f"SELECT o_orderkey, {_LIST(INTENTS)}[o_orderkey % {len(INTENTS)} + 1] AS intent FROM orders")
def assistant_ask(spark, sf):
    """One question for each order, routed to the query that answers it."""
    i = (F.col("o_orderkey") % len(QUESTIONS)).cast("int")
    q, m = F.get(F.array(*map(F.lit, QUESTIONS)), i), F.get(F.array(*map(F.lit, MATCHED)), i)
    return s.read(spark, sf, "orders").select("o_orderkey", reads.intent(q, m).alias("intent"))


@query("report_question", """
SELECT o_orderkey, ['declined', 'declined', 'finding', 'wording', 'assistant:alerts', 'assistant:overview'][o_orderkey % 6 + 1] AS route FROM orders
""")  # fmt: skip
def report_question(spark, sf):
    asked = ["", "Is he guilty?", "What does F-03 rest on?", 'Where does it say "paid twice"?', "Any alert?", "Hm"]
    q = F.get(F.array(*map(F.lit, asked)), (F.col("o_orderkey") % 6).cast("int"))
    return s.read(spark, sf, "orders").select("o_orderkey", reads.route(q, F.lit(0), ["guilty", "sentence him"]).alias("route"))


@query("assistant_match", """
WITH t AS (SELECT DISTINCT term FROM (SELECT unnest(['CUSTOMER 000000007', 'customer#00000001', 'nobody here']) AS term)),
n AS (SELECT c_custkey AS id, c_name AS label, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS l FROM customer), f AS (SELECT term, regexp_replace(lower(term), '[^a-z0-9]', '', 'g') AS t FROM t),
e AS (SELECT term, min({'label': label, 'id': id}) AS e FROM f JOIN n ON l = f.t GROUP BY 1), p AS (SELECT term, min({'n': length(label), 'label': label, 'id': id}) AS p FROM f JOIN n ON contains(l, f.t) GROUP BY 1)
SELECT term, coalesce(e.id, p.id) AS id, coalesce(e.label, p.label) AS label, e IS NOT NULL AS exact FROM t LEFT JOIN e USING (term) LEFT JOIN p USING (term)
""")  # fmt: skip
def assistant_match(spark, sf):
    terms = spark.createDataFrame([("CUSTOMER 000000007",), ("customer#00000001",), ("nobody here",)], "term string")
    return reads.match(s.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")), terms)


@query("assistant_entity", f"""
WITH {REPORTS_SQL} SELECT k, 'record' AS kind FROM reps WHERE plate = (SELECT min(plate) FROM reps) UNION ALL SELECT o_custkey, 'relation' FROM orders WHERE o_custkey = 7
""")  # fmt: skip
def assistant_entity(spark, sf):
    """Relations of an entity and the records whose identifier lists hold its key."""
    from ..functions.identifiers import find_vehicle_identifiers

    r = s.reports(spark, sf).select("k", find_vehicle_identifiers(F.col("text")).alias("plates"))
    key = r.agg(F.min(F.get("plates", F.lit(0))))
    hits = r.where(F.array_contains("plates", key.scalar())).select("k", F.lit("record").alias("kind"))
    return hits.unionByName(s.read(spark, sf, "orders").where("o_custkey = 7").select(F.col("o_custkey").alias("k"), F.lit("relation").alias("kind")))


@query("source_view", f"""
WITH {REPORTS_SQL} SELECT k, 4 AS line, true AS cited FROM reps UNION ALL SELECT k, 8, false FROM reps
""")  # fmt: skip
def source_view(spark, sf):
    """The line that a citation names and all others with the same words; the name of the accused, cited at line 4."""
    r = s.report_units(spark, sf).select(F.col("evidence_id").alias("k"), (F.col("place") + 1).alias("line"), "text")
    name = F.regexp_extract("text", r"^Accused: ([^.]+)", 1)
    cited = r.where("line = 4").select(F.col("k").alias("_k"), name.alias("name"))
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    hits = r.join(cited, F.col("k") == F.col("_k")).where(fold(F.col("text")).contains(fold(F.col("name"))))
    return hits.select("k", "line", (F.col("line") == 4).alias("cited"))


STAGES = ["received", "detected", "extracted", "grounded", "validated", "resolved", "related", "correlated", "completed"]


@query("evidence_stages", f"""
WITH st AS (SELECT unnest({_LIST(STAGES)}) AS stage, unnest(range(9))::INT AS place), r AS (SELECT user_id, event_id % 9 AS p, count(*) AS runs, arg_max(event_type, (ts, event_id)) AS state FROM events WHERE event_id % 4 <> 1 GROUP BY 1, 2)
SELECT u.user_id, st.place, st.stage, coalesce(r.state, 'pending') AS state, coalesce(r.runs, 0) AS attempts, st.place = (SELECT max(p) FROM r x WHERE x.user_id = u.user_id) AS current
FROM (SELECT DISTINCT user_id FROM events WHERE event_id % 4 <> 1) u, st LEFT JOIN r ON r.user_id = u.user_id AND r.p = st.place
""")  # fmt: skip
def evidence_stages(spark, sf):
    """Runs put on the nine stages in order; a stage without a run is pending, the last one reached is current."""
    e = s.read(spark, sf, "events").where("event_id % 4 <> 1")
    runs = e.select("user_id", (F.col("event_id") % 9).cast("int").alias("place"), F.col("event_type").alias("state"), F.col("ts").alias("at"), F.col("event_id").alias("run_id"))
    return casereads.evidence_stages(runs, "user_id", STAGES)


# Identities


@query("canonicalize_fields", """
SELECT c_custkey, CASE n WHEN 0 THEN 'phone' WHEN 1 THEN 'phone' WHEN 2 THEN 'phone' WHEN 3 THEN 'email' WHEN 4 THEN 'upi' WHEN 5 THEN 'reference' WHEN 6 THEN 'device' WHEN 7 THEN 'vehicle' WHEN 8 THEN 'organisation' WHEN 9 THEN 'person' WHEN 10 THEN 'location' END AS entity_type,
  CASE n WHEN 0 THEN (9000000000 + c_custkey)::VARCHAR WHEN 1 THEN (9000000000 + c_custkey)::VARCHAR WHEN 2 THEN (9000000000 + c_custkey)::VARCHAR WHEN 3 THEN 'a' || c_custkey || '@mail.example.com' WHEN 4 THEN 'a' || c_custkey || '@okbank'
    WHEN 5 THEN 'ref000' || c_custkey WHEN 6 THEN 'dev' || c_custkey WHEN 7 THEN 'MH12AB' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') WHEN 8 THEN 'steel ' || c_custkey WHEN 9 THEN 'asha rao' WHEN 10 THEN 'linking road ' || c_custkey END AS key
FROM (SELECT c_custkey, c_custkey % 12 AS n FROM customer)
""")  # fmt: skip
def canonicalize_fields(spark, sf):
    """One value for each of the identity fields, and one that identifies nothing."""
    k = F.col("c_custkey")
    c, n = k.cast("string"), F.col("c_custkey") % 12
    phone = F.concat(F.lit("+91-"), (k + 9_000_000_000).cast("string"))
    values = [
        ("sender", phone), ("receiver", phone), ("phone_numbers", phone), ("email_addresses", F.concat(F.lit("A"), c, F.lit("@Mail.Example.com"))), ("account_identifiers", F.concat(F.lit("A"), c, F.lit("@okbank"))),
        ("transaction_reference", F.concat(F.lit("REF-OOO"), c)), ("device_identifier", F.concat(F.lit("DEV-"), c)), ("vehicle_identifiers", F.concat(F.lit("mh 12 ab "), F.lpad((k % 10000).cast("string"), 4, "0"))),
        ("organisation_names", F.concat(F.lit("Steel "), c, F.lit(" Pvt Ltd"))), ("person_names", F.lit("Asha  RAO")), ("location_names", F.concat(F.lit("Linking Road "), c)), ("phone_numbers", F.lit("12 34")),
    ]
    node = None
    for i, (field, value) in enumerate(values):
        out = canonical.canonicalize(field, value)
        node = F.when(n == i, out) if node is None else node.when(n == i, out)
    return s.read(spark, sf, "customer").select("c_custkey", node.alias("x")).select("c_custkey", "x.entity_type", "x.key")


@query("merge_split_repoint", """
WITH m AS (SELECT s_suppkey AS id, first_value(s_suppkey) OVER (PARTITION BY s_nationkey, s_suppkey % 7 ORDER BY round(s_acctbal)::BIGINT DESC, s_suppkey) AS survivor FROM supplier),
e AS (SELECT DISTINCT l_suppkey AS subject, (l_suppkey + l_linenumber) % 50 + 1 AS object FROM lineitem)
SELECT DISTINCT coalesce(a.survivor, subject) AS subject, coalesce(b.survivor, object) AS object FROM e LEFT JOIN m a ON a.id = subject LEFT JOIN m b ON b.id = object WHERE coalesce(a.survivor, subject) <> coalesce(b.survivor, object)
""")  # fmt: skip
def merge_split_repoint(spark, sf):
    """Edges moved to the surviving entities, without self edges and repeats."""
    p = s.read(spark, sf, "supplier")
    rows = p.select(F.col("s_nationkey").alias("case_id"), (F.col("s_suppkey") % 7).alias("key"), F.col("s_suppkey").alias("id"), F.round("s_acctbal").cast("long").alias("links"), F.lit(0).alias("created_at"))
    e = s.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("subject"), ((F.col("l_suppkey") + F.col("l_linenumber")) % 50 + 1).alias("object")).distinct()
    return resolve.repoint(e, resolve.survivors(rows))


@query("co_occurrence_edges_alone", f"""
WITH {OCCURRENCES_SQL}, e AS (SELECT evidence_id AS record_id, entity_type || ':' || key AS e FROM occ WHERE evidence_id % 3 <> 0 AND entity_type = 'email' UNION SELECT doc_id, 'device:' || regexp_replace(lower('imei ' || source || '-device'), '[^a-z0-9]', '', 'g') FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT record_id FROM e GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)
SELECT a.record_id, a.e AS subject, b.e AS object FROM e a JOIN e b ON a.record_id = b.record_id AND a.e < b.e WHERE a.record_id IN (SELECT record_id FROM n)
""")  # fmt: skip
def co_occurrence_edges_alone(spark, sf):
    """Only in records that state no stronger relation (here: every third one does)."""
    from .record_queries import _records

    found = resolve.identities(_records(spark, sf))
    stronger = s.read(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("record_id"))
    return resolve.co_occurrence_edges(found.join(stronger, "record_id", "left_anti")).select("record_id", "subject", "object")
