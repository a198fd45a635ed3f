"""Alert rules. Every rule gives (case_id, rule, severity, key); union them and keep each key once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the rules.
HIGH_VALUE, REPEATED, RECURRING, SIGHTINGS = 50_000, 2, 3, 3
RECURRING_TYPES = ("upi", "upi_id", "phone", "email", "account")


def alert(rows: DataFrame, rule: str, severity: str, *parts: Column) -> DataFrame:
    key = F.concat_ws(":", *(p.cast("string") for p in parts))
    return rows.select("case_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), key.alias("key"))


def high_value(txns: DataFrame, least: float = HIGH_VALUE) -> DataFrame:
    return alert(txns.where(F.col("amount") >= least), "HIGH_VALUE_TRANSFER", "HIGH", F.col("id"))


def repeated_recipient(txns: DataFrame) -> DataFrame:
    n = txns.where("receiver IS NOT NULL").groupBy("case_id", F.lower("receiver").alias("r")).count()
    return alert(n.where(F.col("count") >= REPEATED), "REPEATED_RECIPIENT", "CRITICAL", F.col("r"))


def recurring_identifier(entities: DataFrame) -> DataFrame:
    """Entity rows, not sightings, are counted: a resolver that keeps one row an identity never fires it."""
    n = entities.where(F.col("entity_type").isin(*RECURRING_TYPES)).groupBy("case_id", "entity_type", "key").count()
    return alert(n.where(F.col("count") >= RECURRING), "RECURRING_IDENTIFIER", "HIGH", F.col("entity_type"), F.col("key"))


def recurring_identifier_occurrences(occurrences: DataFrame) -> DataFrame:
    """The variant that counts evidence files in which an identifier is seen."""
    n = occurrences.where(F.col("entity_type").isin(*RECURRING_TYPES)).groupBy("case_id", "entity_type", "key").agg(F.count_distinct("evidence_id").alias("n"))
    return alert(n.where(F.col("n") >= RECURRING), "RECURRING_IDENTIFIER_OCCURRENCES", "HIGH", F.col("entity_type"), F.col("key"))


def phishing_link(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Cases with a phishing e-mail and a web address."""
    mail = events.where("event_type = 'phishing_email'").select("case_id").distinct()
    return alert(mail.join(entities.where("entity_type = 'url'").select("case_id"), "case_id", "left_semi"), "PHISHING_LINK", "HIGH", F.lit("case"))


def rapid_sequence(found: DataFrame) -> DataFrame:
    return alert(found, "RAPID_TRANSACTION_SEQUENCE", "MEDIUM", F.col("first_id"), F.col("second_id"))


def recurring_vehicle(records: DataFrame) -> DataFrame:
    """(vehicle, place) listed together by three records or more; records: case_id, record_id, vehicles[], places[]."""
    both = records.select("case_id", "record_id", F.explode("vehicles").alias("vehicle"), "places")
    both = both.select("case_id", "record_id", "vehicle", F.explode("places").alias("place"))
    n = both.groupBy("case_id", "vehicle", "place").count()
    return alert(n.where(F.col("count") >= SIGHTINGS), "RECURRING_VEHICLE_AT_LOCATION", "MEDIUM", F.col("vehicle"), F.col("place"))


def bridge_entity(measures: DataFrame, evidence: DataFrame, top: int = 20, least: int = 2) -> DataFrame:
    """Of a case's `top` nodes by betweenness, cut nodes with `least` evidence files. evidence: case_id, node, n_evidence."""
    from .rollups import top_per

    best = top_per(measures, ["case_id"], [F.desc("betweenness"), F.asc("node")], top).where("is_cut")
    seen = best.join(evidence, ["case_id", "node"]).where(F.col("n_evidence") >= least)
    return alert(seen, "BRIDGE_ENTITY", "MEDIUM", F.col("node"))


def shared_device(records: DataFrame) -> DataFrame:
    """Devices with two or more phone numbers, in normal form: the sender's, else the record's only one. records: case_id, device,
    sender, phones[]."""
    from ..functions.canonical import canonicalize

    device = F.trim("device")
    said = F.nullif(F.trim("sender"), F.lit(""))
    owner = F.coalesce(said, F.when(F.size("phones") == 1, F.element_at("phones", 1)))
    n = records.withColumns({"device": device, "owner": canonicalize("phone_numbers", owner)["key"]}).where("device <> '' AND owner IS NOT NULL")
    n = n.groupBy("case_id", "device").agg(F.count_distinct("owner").alias("n"))
    return alert(n.where(F.col("n") >= 2), "SHARED_DEVICE", "HIGH", F.col("device"))


def late_arrival(first: DataFrame, cases: DataFrame, least_s: int = 86_400) -> DataFrame:
    """Entities first seen `least_s` seconds or more after their case began. first: case_id, entity_id, first_at; cases: case_id,
    created_at."""
    j = first.join(cases.select(F.col("case_id").alias("_c"), "created_at"), F.col("case_id") == F.col("_c"))
    late = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("first_at")) >= least_s * 1_000_000
    return alert(j.where(late), "LATE_ARRIVING_IDENTITY", "LOW", F.col("entity_id"))


def record_places(records: DataFrame) -> DataFrame:
    """The first place that each record names: record_id, place. records: record_id, place, at, id."""
    return records.where("place IS NOT NULL").groupBy("record_id").agg(F.min_by("place", F.struct("at", "id")).alias("place"))


def pair_rule(found: DataFrame, rule: str, severity: str, *keys: str) -> DataFrame:
    """Rules whose finding is the alert: bursts, relays, silences, pre-incident contact, convergence, corridors."""
    return alert(found, rule, severity, *(F.col(k) for k in keys))


def evaluate(*alerts: DataFrame, raised: DataFrame | None = None, unique: dict[str, DataFrame] | None = None) -> DataFrame:
    """All alerts, each key once, without those already raised. unique: rule -> alerts of that rule alone that hold each key once
    by construction, which need no shuffle but against what is raised of their rule."""
    keys = ["case_id", "rule", "key"]
    out = reduce(DataFrame.unionByName, alerts).dropDuplicates(keys)
    out = out.join(raised, keys, "left_anti") if raised is not None else out
    for rule, rows in (unique or {}).items():
        out = out.unionByName(rows.join(raised.where(F.col("rule") == rule), keys, "left_anti") if raised is not None else rows)
    return out


# How a relation reads in a sequence of events, and its closing line.
STEP_PHRASES = {
    "CALLED": "{subject} called {object}.",
    "MESSAGED": "{subject} sent a message to {object}.",
    "COMMUNICATED_WITH": "Contact is recorded between {subject} and {object}, without stating who initiated it.",
    "TRANSFERRED_TO": "{subject} sent money to {object}.",
    "REQUESTED_PAYMENT_FROM": "{subject} asked {object} for money. The source does not record that any money moved.",
    "USED_VEHICLE": "{subject} is recorded driving, riding or using {object}.",
    "LOCATED_AT": "{subject} is placed at {object}. The source does not establish when.",
    "ASSOCIATED_WITH": "{subject} and {object} are named as the parties to the same record.",
    "MENTIONED_WITH": "{subject} and {object} are named in the same record, with no relationship stated between them.",
}
NEUTRAL_PHRASE = "{subject} and {object} are recorded in the same statement."
UNRESOLVED = "an unresolved identity"
GAP_AFTER = "Nothing having been recorded is not the same as nothing having happened."
CLOSING = (
    "This is what the sources record, in the order they record it. What it means is a matter for the "
    "reader; the system does not draw a conclusion from a sequence."
)


def statements(relations: DataFrame) -> DataFrame:
    """relations with `statement`: the sentence of their type; undirected calls and messages read as contact. Missing ends read as
    unresolved."""

    def sentence(template: str) -> Column:
        before, middle = template.split("{subject}")
        between, after = middle.split("{object}")
        end = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNRESOLVED))
        return F.concat(F.lit(before), end("subject"), F.lit(between), end("object"), F.lit(after))

    neutral = ~F.coalesce("directed", F.lit(True)) & F.col("relation_type").isin("CALLED", "MESSAGED")
    out = F.when(neutral, sentence(STEP_PHRASES["COMMUNICATED_WITH"]))
    for kind, template in STEP_PHRASES.items():
        out = out.when(F.col("relation_type") == kind, sentence(template))
    return relations.withColumn("statement", out.otherwise(sentence(NEUTRAL_PHRASE)))


def span_words(seconds: Column) -> Column:
    """Under 48 hours in hours, else in days, rounded half to even."""
    hours = seconds / 3600
    number = lambda c: F.bround(c, 0).cast("long").cast("string")
    return F.when(hours < 48, F.concat(number(hours), F.lit(" hours pass"))).otherwise(F.concat(number(hours / 24), F.lit(" days pass")))


def sequence(steps: DataFrame, keys: list[str], gap_s: int = 6 * 3_600) -> DataFrame:
    """keys, place (from 0), kind (step, gap or closing) and statement of the story of each key: steps with a time in order, a gap
    before each that comes `gap_s` seconds or more after its predecessor, a marker where some but not all have no time, those
    without a time in the order of their ids, and the closing line. steps: keys, id, at, statement."""
    from .temporal import gap_steps

    row = lambda part, at, id_, sub, kind, text: F.struct(
        F.lit(part).alias("part"), at.alias("at"), id_.alias("id"), F.lit(sub).alias("sub"), F.lit(kind).alias("kind"), text.alias("statement")
    )
    none_at, none_id = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast(steps.schema["id"].dataType)
    timed = gap_steps(steps.where("at IS NOT NULL"), keys, gap_s).join(steps.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("id").alias("_id"), "statement"),
                                                                       [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("id") == F.col("_id")])
    gap_text = F.concat(F.lit("Then "), span_words(F.col("gap_s")), F.lit(f" in which no contact between them is recorded. {GAP_AFTER}"))
    told = timed.select(*keys, F.when(F.col("kind") == "gap", row(0, F.col("at"), F.col("id"), 0, "gap", gap_text)).otherwise(row(0, F.col("at"), F.col("id"), 1, "step", F.col("statement"))).alias("r"))
    untimed = steps.where("at IS NULL").select(*keys, row(2, none_at, F.col("id"), 1, "step", F.col("statement")).alias("r"))
    n = steps.groupBy(*keys).agg(F.count("at").alias("timed"), F.count_if(F.col("at").isNull()).alias("open"))
    one = F.col("open") == 1
    marker = F.concat(
        F.col("open").cast("string"), F.when(one, " further record in this pattern carries").otherwise(" further records in this pattern carry"),
        F.lit(" no established time, so "), F.when(one, "it is").otherwise("they are"), F.lit(" listed below rather than placed in the order above."),
    )
    marks = n.where("timed > 0 AND open > 0").select(*keys, row(1, none_at, none_id, 0, "gap", marker).alias("r"))
    ends = n.select(*keys, row(3, none_at, none_id, 0, "closing", F.lit(CLOSING)).alias("r"))
    every = told.unionByName(untimed).unionByName(marks).unionByName(ends)
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("r.part", "r.at", "r.id", "r.sub")
    return every.withColumn("place", F.row_number().over(w) - 1).select(*keys, "place", "r.kind", "r.statement")
