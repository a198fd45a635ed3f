"""Records to entities, occurrences and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import KINDS, canonicalize
from ..functions.scores import RELATION_CONFIDENCE, RELATION_DEFAULT, lookup

CO_OCCURRENCE_MOST, CO_OCCURRENCE_SKIP = 8, "location"
CALL_SOURCES = ("call_log", "cdr")


def identities(records: DataFrame) -> DataFrame:
    """Every identity that a record's identity fields state: case_id, evidence_id, record_id, created_at, field, entity_type,
    display, key. Fields that the records lack are left out; values that identify nothing give no row."""
    kinds = {f.name: f.dataType.typeName() for f in records.schema.fields}
    parts = []
    for field in KINDS:
        if field in kinds:
            values = F.col(field) if kinds[field] == "array" else F.array(F.col(field))
            parts.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), _node(field)))
    rows = records.select("case_id", "evidence_id", "record_id", "created_at", F.explode(F.concat(*parts)).alias("x"))
    return rows.where("x.id.key IS NOT NULL").select(
        "case_id", "evidence_id", "record_id", "created_at", "x.field", "x.id.entity_type", "x.id.display", "x.id.key"
    )


def _node(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), canonicalize(field, v.cast("string")).alias("id"))


def entities(found: DataFrame) -> DataFrame:
    """One row for each (case_id, entity_type, key): the first display value and when it was first seen."""
    best = found.groupBy("case_id", "entity_type", "key").agg(F.min(F.struct("created_at", "record_id", "display")).alias("f"), F.count("*").alias("mentions"))
    return best.select("case_id", "entity_type", "key", F.col("f.display").alias("display"), F.col("f.created_at").alias("first_seen"), "mentions")


def occurrences(found: DataFrame) -> DataFrame:
    """One row for each (entity, evidence, field): that of the first record."""
    keys = ["case_id", "entity_type", "key", "evidence_id", "field"]
    best = found.groupBy(*keys).agg(F.min(F.struct("created_at", "record_id", "display")).alias("f"))
    return best.select(*keys, F.col("f.record_id").alias("record_id"), F.col("f.display").alias("observed_value"), F.col("f.created_at").alias("created_at"))


def party_relation(source: Column, amount: Column, role: Column) -> Column:
    """The type of a stated sender-receiver relation, decided in this order."""
    has = amount.isNotNull()
    return (
        F.when(source.isin(*CALL_SOURCES), "CALLED")
        .when(has & (role == "balance"), "ASSOCIATED_WITH")
        .when(has & (role.isin("payment", "fee") | (source == "bank_record")), "TRANSFERRED_TO")
        .when(has & (role == "request"), "REQUESTED_PAYMENT_FROM")
        .when(source.isin("email", "chat_export", "screenshot"), "MESSAGED")
        .otherwise("ASSOCIATED_WITH")
    )


def edge(rows: DataFrame, directed: bool) -> DataFrame:
    """Relations without self edges, undirected ends in order, with the confidence of their type."""
    rows = rows.where("subject <> object")
    if not directed:
        rows = rows.withColumns({"subject": F.least("subject", "object"), "object": F.greatest("subject", "object")})
    return rows.withColumns({"directed": F.lit(directed), "confidence": lookup(RELATION_CONFIDENCE, F.col("relation_type"), RELATION_DEFAULT)})


def stated_party_edges(records: DataFrame) -> DataFrame:
    """records: case_id, record_id, evidence_id, source_type, sender, receiver, amount, amount_role, at."""
    rows = records.where("sender IS NOT NULL AND receiver IS NOT NULL").select(
        "case_id", "record_id", "evidence_id", "at",
        canonicalize("sender", F.col("sender"))["key"].alias("subject"), canonicalize("receiver", F.col("receiver"))["key"].alias("object"),
        party_relation(F.col("source_type"), F.col("amount"), F.coalesce("amount_role", F.lit("unknown"))).alias("relation_type"),
    )
    return edge(rows, True)


def call_log_edges(records: DataFrame) -> DataFrame:
    """Call records without both roles and with exactly two numbers: undirected contact."""
    rows = records.where(F.col("source_type").isin(*CALL_SOURCES) & (F.col("sender").isNull() | F.col("receiver").isNull()) & (F.size("phone_numbers") == 2))
    rows = rows.select(
        "case_id", "record_id", "evidence_id", "at", F.lit("COMMUNICATED_WITH").alias("relation_type"),
        canonicalize("phone_numbers", F.element_at("phone_numbers", 1))["key"].alias("subject"),
        canonicalize("phone_numbers", F.element_at("phone_numbers", 2))["key"].alias("object"),
    )
    return edge(rows, False)


def co_occurrence_edges(found: DataFrame) -> DataFrame:
    """All pairs of a record that names two to eight different entities other than places; records that name more state
    nothing about any pair. found: identities."""
    sets = (
        found.where(F.col("entity_type") != CO_OCCURRENCE_SKIP)
        .groupBy("case_id", "record_id", "evidence_id")
        .agg(F.array_sort(F.collect_set(F.concat_ws(":", "entity_type", "key"))).alias("e"))
        .where(F.size("e").between(2, CO_OCCURRENCE_MOST))
    )
    pairs = sets.select("case_id", "record_id", "evidence_id", "e", F.posexplode("e").alias("i", "subject")).select(
        "case_id", "record_id", "evidence_id", "subject", F.explode(F.slice(F.col("e"), F.col("i") + 2, F.size("e"))).alias("object")
    )
    return edge(pairs.withColumn("relation_type", F.lit("MENTIONED_WITH")), False)


def upsert(old: DataFrame, new: DataFrame, key: str, reviewed: Column) -> DataFrame:
    """old with new rows put in by key; rows that a person has reviewed stay as they are. Same columns on both sides."""
    o, n = F.struct(*old.columns).alias("o"), F.struct(*old.columns).alias("n")
    a = old.withColumn("_reviewed", reviewed).select(F.col(key).alias("_k"), o, "_reviewed")
    b = new.select(F.col(key).alias("_j"), n)
    joined = a.join(b, F.col("_k") == F.col("_j"), "full_outer")
    pick = F.when(F.col("_reviewed") | F.col("n").isNull(), F.col("o")).otherwise(F.col("n"))
    return joined.select(pick.alias("x")).select("x.*")


def insert_new(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key is neither stored nor repeated."""
    return rows.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def survivors(rows: DataFrame) -> DataFrame:
    """Split entities: id -> survivor of its (case_id, key): most links, then oldest, then smallest id.
    rows: case_id, key, id, links, created_at."""
    best = rows.groupBy("case_id", "key").agg(F.min(F.struct((-F.col("links")).alias("l"), "created_at", "id")).alias("f"))
    return rows.join(best, ["case_id", "key"]).select("id", F.col("f.id").alias("survivor"))


def repoint(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends at survivors, without self edges and repeats. edges: subject, object, ..."""
    m = lambda c: mapping.select(F.col("id").alias(f"_{c}"), F.col("survivor").alias(f"_to_{c}"))
    out = edges.join(m("s"), F.col("subject") == F.col("_s"), "left").join(m("o"), F.col("object") == F.col("_o"), "left")
    out = out.withColumns({"subject": F.coalesce("_to_s", "subject"), "object": F.coalesce("_to_o", "object")})
    return out.select(*edges.columns).where("subject <> object").dropDuplicates()
