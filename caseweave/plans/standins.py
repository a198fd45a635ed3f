"""Evidence tables drawn from the given ones, and the registry of queries.

Each stand-in is plain column work on Parquet scans, so filters and pruned columns reach the files.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that must give the same rows."""

    def take(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = re.sub(r"(?<!['\"])\bat\b(?!['\"])", '"at"', sql.strip())  # a reserved word in the SQL
        return f

    return take


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as undirected contacts: case_id 0, subject the user, object k of props; self contacts left out."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.lit(0).alias("case_id"),
        F.col("event_id").alias("id"),
        F.col("user_id").alias("subject"),
        F.get_json_object("props", "$.k").cast("bigint").alias("object"),
        F.col("ts").alias("at"),
        F.lit("CALLED").alias("relation_type"),
        F.when(F.col("event_type") == "error", "rejected").otherwise("machine_extracted").alias("status"),
    ).where("subject <> object")


CONTACTS_SQL = """contacts AS (
  SELECT 0 AS case_id, event_id AS id, user_id AS subject, CAST(json_extract_string(props, '$.k') AS BIGINT) AS object, ts AS at,
    CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'machine_extracted' END AS status
  FROM events WHERE user_id <> CAST(json_extract_string(props, '$.k') AS BIGINT)
)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with their customer's nation as case."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("c_nationkey").alias("case_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("at"),
        F.col("o_custkey").alias("sender"),
        F.col("o_orderpriority").alias("receiver"),
        F.col("o_orderstatus").alias("status"),
    )


TRANSACTIONS_SQL = """txns AS (
  SELECT c_nationkey AS case_id, o_orderkey AS id, o_totalprice AS amount, o_orderdate AS at, o_custkey AS sender,
    o_orderpriority AS receiver, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey
)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to orders and customer: a customer's relation to a supplier, with the order as its evidence."""
    li, o, c = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    # orders find their customer before they meet their lines, the larger side, which move once and by as many tasks as they need
    oc, n = o.join(c, o.o_custkey == c.c_custkey), parts(spark, sf_dir, "lineitem")
    if n > spark.sparkContext.defaultParallelism:
        li, oc = li.repartition(n, "l_orderkey"), oc.repartition(n, "o_orderkey")
    rows = li.join(oc, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("c_nationkey").alias("case_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("subject"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("object"),
        F.when(F.col("l_returnflag") == "A", "CALLED").when(F.col("l_returnflag") == "N", "TRANSFERRED_TO").otherwise("MESSAGED").alias("relation_type"),
        F.col("l_shipdate").alias("at"),
        F.round(1 - F.col("l_discount") * 5, 4).alias("confidence"),
        F.col("l_orderkey").alias("evidence_id"),
        F.when(F.col("l_linestatus") == "F", "human_verified").when(F.col("l_tax") >= 0.08, "rejected").otherwise("machine_extracted").alias("status"),
    )


#: Relations that one task sums up, about.
PART_ROWS = 500_000


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Tasks for what is made of a table's rows: one for each half a million, by the files' own counts, and one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-read(spark, sf_dir, name).count() // PART_ROWS))


def edges(spark: SparkSession, sf_dir: str, **of) -> DataFrame:
    """The graph of the relations, summed up in as many tasks as their number asks for. of: as in build_edges."""
    from ..operators.graph import build_edges

    # relations are dealt by order, which is their evidence, wherever there are more parts than cores
    n = parts(spark, sf_dir, "lineitem")
    return build_edges(relations(spark, sf_dir), parts=n, dealt=n > spark.sparkContext.defaultParallelism, **of)


RELATIONS_SQL = """rels AS (
  SELECT c_nationkey AS case_id, l_orderkey * 8 + l_linenumber AS id, 'C' || c_custkey AS subject, 'S' || l_suppkey AS object,
    CASE l_returnflag WHEN 'A' THEN 'CALLED' WHEN 'N' THEN 'TRANSFERRED_TO' ELSE 'MESSAGED' END AS relation_type,
    l_shipdate AS at, round(1 - l_discount * 5, 4) AS confidence, l_orderkey AS evidence_id,
    CASE WHEN l_linestatus = 'F' THEN 'human_verified' WHEN l_tax >= 0.08 THEN 'rejected' ELSE 'machine_extracted' END AS status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""

EDGES_SQL = RELATIONS_SQL + """, edges AS (
  SELECT case_id, least(subject, object) AS u, greatest(subject, object) AS v, max(confidence) AS weight, count(*) AS observations,
    count(DISTINCT evidence_id) AS n_evidence, string_agg(DISTINCT relation_type, ',' ORDER BY relation_type) AS relation_types
  FROM rels WHERE status <> 'rejected' AND confidence >= 0 AND subject <> object GROUP BY 1, 2, 3
)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation as cases, with a declared incident window for two in three."""
    n = read(spark, sf_dir, "nation")
    declared = F.col("n_nationkey") % 3 != 2
    return n.select(
        F.col("n_nationkey").alias("case_id"),
        F.col("n_name").alias("case_number"),
        F.col("n_regionkey").alias("owner_id"),
        F.when(declared, F.lit("1997-01-01").cast("timestamp_ntz")).alias("incident_start"),
        F.when(declared, F.lit("1998-12-31").cast("timestamp_ntz")).alias("incident_end"),
    )


CASES_SQL = """cases AS (
  SELECT n_nationkey AS case_id, n_name AS case_number, n_regionkey AS owner_id,
    CASE WHEN n_nationkey % 3 <> 2 THEN TIMESTAMP '1997-01-01' END AS incident_start,
    CASE WHEN n_nationkey % 3 <> 2 THEN TIMESTAMP '1998-12-31' END AS incident_end
  FROM nation
)"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail and network addresses in documents: case_id (the source), evidence_id, entity_type, key, confidence."""
    from ..functions.identifiers import find_email_addresses, find_ip_addresses

    d = read(spark, sf_dir, "documents").where(F.col("text").rlike(r"[@0-9]"))
    found = F.concat(
        F.transform(find_email_addresses(F.col("text")), lambda x: F.struct(F.lit("email").alias("entity_type"), x.alias("key"))),
        F.transform(find_ip_addresses(F.col("text")), lambda x: F.struct(F.lit("ip").alias("entity_type"), x.alias("key"))),
    )
    return d.select(F.col("source").alias("case_id"), F.col("doc_id").alias("evidence_id"), F.explode(found).alias("x")).select(
        "case_id", "evidence_id", "x.entity_type", "x.key", F.when(F.col("x.entity_type") == "email", 0.93).otherwise(0.86).alias("confidence")
    )


OCCURRENCES_SQL = """occ AS (
  SELECT DISTINCT source AS case_id, doc_id AS evidence_id, entity_type, key, CASE WHEN entity_type = 'email' THEN 0.93::DOUBLE ELSE 0.86::DOUBLE END AS confidence
  FROM (
    SELECT source, doc_id, 'email' AS entity_type, lower(unnest(regexp_extract_all(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b'))) AS key FROM documents
    UNION ALL
    SELECT source, doc_id, 'ip', unnest(regexp_extract_all(text, '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b')) FROM documents
  )
)"""


def shared_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """occurrences whose addresses are those of a host's desk, so that documents and cases share them."""
    desk = F.concat(F.lit("desk@"), F.substring_index("key", "@", -1))
    return occurrences(spark, sf_dir).withColumn("key", F.when(F.col("entity_type") == "email", desk).otherwise(F.col("key"))).distinct()


SHARED_SQL = OCCURRENCES_SQL.replace("occ AS (", "every AS (", 1) + """, occ AS (
  SELECT DISTINCT case_id, evidence_id, entity_type, CASE WHEN entity_type = 'email' THEN 'desk@' || split_part(key, '@', 2) ELSE key END AS key, confidence FROM every
)"""


FIRST_NAMES, LAST_NAMES = ("Asha", "Ravi", "Meera", "Yash", "Priya"), ("Rao", "Kumar", "Sharma", "Gupta")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A police report on each order, its facts drawn from the order: k, text (eight lines), amount, at."""
    from ..operators.facts import spread

    o = spread(read(spark, sf_dir, "orders"))
    k = F.col("o_orderkey")
    pick = lambda names, i: F.get(F.array(*map(F.lit, names)), (i % len(names)).cast("int"))
    name = lambda i, j: F.concat_ws(" ", pick(FIRST_NAMES, i), pick(LAST_NAMES, j))
    accused, witness = name(k, k), name(k + 2, k + 1)
    plate = F.concat(F.lit("MH"), F.lpad((k % 90 + 10).cast("string"), 2, "0"), F.lit("AB"), F.lpad((k % 10000).cast("string"), 4, "0"))
    number = lambda c: c.cast("string")
    lines = [
        F.concat(F.lit("FIR No: "), number(k % 99999), F.lit(" / 2024")),
        F.lit("Police Station: Andheri East"),
        F.concat(F.lit("under section "), number(k % 200 + 300), F.lit(" IPC")),
        F.concat(F.lit("Accused: "), accused, F.lit(".")),
        F.concat(F.lit("Witness "), witness, F.lit(" was driving "), plate, F.lit(".")),
        F.concat(F.lit("Vehicle "), plate, F.lit(" was observed parked near Linking Road.")),
        F.concat(F.lit("Paid INR "), F.format_number("o_totalprice", 2), F.lit(" on "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit(" at "), F.date_format("o_orderdate", "HH:mm"),
                 F.lit(", UTR: REF"), F.lpad(number(k), 9, "0"), F.lit(", call 98765 "), F.lpad(number(k % 100000), 5, "0")),
        F.concat(F.lit("Accused "), accused, F.lit(" was seen near Crawford Market.")),
    ]
    return o.select(k.alias("k"), F.concat_ws("\n", *lines).alias("text"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("at"))


_NAME = "['Asha', 'Ravi', 'Meera', 'Yash', 'Priya'][({i}) % 5 + 1] || ' ' || ['Rao', 'Kumar', 'Sharma', 'Gupta'][({j}) % 4 + 1]"
REPORTS_SQL = f"""reps AS (
  SELECT o_orderkey AS k, {_NAME.format(i="o_orderkey", j="o_orderkey")} AS accused, {_NAME.format(i="o_orderkey + 2", j="o_orderkey + 1")} AS witness,
    'MH' || lpad((o_orderkey % 90 + 10)::VARCHAR, 2, '0') || 'AB' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS plate, o_totalprice AS amount, o_orderdate AS moment,
    'REF' || lpad(o_orderkey::VARCHAR, 9, '0') AS reference, '+9198765' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS phone,
    (o_orderkey % 99999) || '/2024' AS fir, (o_orderkey % 200 + 300) || ' IPC' AS sections
  FROM orders
)"""


def report_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the reports: evidence_id, unit_id (ten an order), place, text."""
    r = reports(spark, sf_dir).select(F.col("k").alias("evidence_id"), F.posexplode(F.split("text", "\n")).alias("place", "text"))
    return r.withColumn("unit_id", F.col("evidence_id") * 10 + F.col("place"))
