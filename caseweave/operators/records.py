"""Units to records, records to events and transactions, grounding, review and model reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from ..functions.scores import band_for, combined_confidence, is_transactional

# Words, flags, fields and floors by which records go to review.
SENSITIVE_MARKERS = (
    "threat", "kill", "blackmail", "extort", "fraud", "scam", "cheat", "police", "fir", "arrest", "aadhaar", "aadhar", "pan card", "otp", "password",
    "dhamki", "jaan se",
)
AMBIGUOUS_MARKERS = ("cropped", "blurry", "incomplete", "low_quality", "partial", "ambiguous", "truncated")
DEGRADED_FLAGS = ("blurry", "cropped", "incomplete", "low_quality", "ambiguous")
IDENTITY_FIELDS = ("sender", "receiver", "participant_a", "participant_b", "chat_participant_identifier")
KEY_FINDING_FIELDS = ("amount", "transaction_reference", "account_identifiers", "event_time")
HIGH_BAND_FLOOR, MEDIUM_BAND_FLOOR = 0.85, 0.60
PRECISION = {"exact": 3, "approximate": 2, "date_only": 1}
ESCALATE_BELOW, COVERAGE = 0.85, 0.85


def build_records(units: DataFrame) -> DataFrame:
    """units (case_id, evidence_id, unit_id, source_type, text) with the facts that all extractors find, one select."""
    from ..functions import moments as m

    t, found = F.col("text"), F.col("_p")
    return units.withColumn("_p", m.people(t)).withColumns({
        "phone_numbers": ids.find_phone_numbers(t), "email_addresses": ids.find_email_addresses(t), "account_identifiers": ids.find_account_identifiers(t),
        "vehicle_identifiers": ids.find_vehicle_identifiers(t), "organisation_names": ids.find_organisations(t), "person_names": m.find_person_names(t, found),
        "person_roles": m.find_person_roles(t, found), "location_names": m.find_locations(t), "transaction_reference": ids.find_transaction_reference(t),
        "device_identifier": ids.find_device_identifier(t), "amount": m.find_amount_detail(t), "moment": m.find_timestamp(t),
    }).drop("_p")


def best_timestamp(blocks: DataFrame, key: str) -> DataFrame:
    """Per key the most precise dated block, the first of equals: key, at, precision, quote. Where only days are stated, the first
    clock elsewhere is put to the day, which makes it approximate; where no day is stated, the first clock stands without a time.
    blocks: key, place, at, precision, quote."""
    from ..functions.moments import find_timestamp

    rank = F.coalesce(*(F.when(F.col("precision") == p, F.lit(n)) for p, n in PRECISION.items()), F.lit(0))
    best = blocks.groupBy(key).agg(
        F.min(F.when(F.col("at").isNotNull(), F.struct((-rank).alias("r"), "place", "at", "precision", "quote"))).alias("b"),
        F.min(F.when(F.col("at").isNull() & F.col("quote").isNotNull(), F.struct("place", F.col("quote").alias("quote")))).alias("c"),
    ).where("b IS NOT NULL OR c IS NOT NULL")
    joined = find_timestamp(F.concat_ws(" ", F.col("b.quote"), F.col("c.quote")))["at"]
    both = (F.col("b.precision") == "date_only") & F.col("c").isNotNull() & joined.isNotNull()
    return best.select(
        key,
        F.when(both, joined).otherwise(F.col("b.at")).alias("at"),
        F.when(both, "approximate").when(F.col("b").isNull(), "time_only").otherwise(F.col("b.precision")).alias("precision"),
        F.when(both, F.concat_ws(" / ", F.col("b.quote"), F.col("c.quote"))).otherwise(F.coalesce("b.quote", "c.quote")).alias("quote"),
    )


def drawn_from(observed: Column, source: Column) -> Column:
    """Whether a reading stands in the source: as a whole, or at least 85 of 100 of its words, without case and spacing."""
    squeeze = lambda c: F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    o, t = squeeze(observed), squeeze(source)
    words = F.regexp_extract_all(o, F.lit(r"[0-9a-z@._+\-/]{2,}"), F.lit(0))
    found = F.size(F.filter(words, lambda w: t.contains(w)))
    return (o != "") & (t.contains(o) | ((F.size(words) > 0) & (found / F.nullif(F.size(words), F.lit(0)) >= COVERAGE)))


def ground(claims: DataFrame, records: DataFrame) -> DataFrame:
    """Model claims (record_id, field, value, quote, citation) against the records: grounded where the quote is drawn from the text
    and the citation is one of the record's; the parser's value wins, and a disagreement is noted. Of a value in several parts,
    by semicolons, those that stand in the text are kept. records: record_id, text, citations[], parsed map."""
    joined = claims.join(records, "record_id", "left")
    cited = F.col("citation").isNull() | F.coalesce(F.array_contains("citations", F.col("citation")), F.lit(False))
    stands = F.coalesce(drawn_from(F.col("quote"), F.col("text")) & cited, F.lit(False))
    parts = F.filter(F.transform(F.split("value", ";"), F.trim), lambda x: (x != "") & F.lower(F.col("text")).contains(F.lower(x)))
    kept = F.when(F.col("value").contains(";"), F.nullif(F.array_join(parts, ";"), F.lit(""))).otherwise(F.col("value"))
    own = F.try_element_at("parsed", F.col("field"))
    return joined.select(
        "record_id", "field", stands.alias("grounded"), F.coalesce(own, F.when(stands, kept)).alias("value"),
        F.coalesce(own.isNotNull() & (own != F.col("value")), F.lit(False)).alias("disagrees"),
    )


def validation(grounded: DataFrame) -> DataFrame:
    """Per record: claims checked, grounded ones and their share to four places."""
    n = F.count_if("grounded")
    return grounded.groupBy("record_id").agg(F.count("*").alias("checked"), n.alias("grounded"), F.bround(n / F.count("*"), 4).alias("validation_confidence"))


def classify_review(records: DataFrame) -> DataFrame:
    """records with confidence, band, validation_status, reasons and requires_review (any reason). Needs model_confidence,
    validation_confidence, text, basis (of the record: direct, inferred or unknown), bases and values (maps of field to basis and to
    value), conflicts[] and quality_flags[]."""
    score = combined_confidence(F.col("model_confidence"), F.col("validation_confidence"))
    vague = lambda b: F.coalesce(b.isin("inferred", "unknown"), F.lit(False))
    stated = lambda f: F.coalesce(F.try_element_at("values", F.lit(f)), F.lit("")) != ""
    named = lambda fields, test: F.array_compact(F.array(*(F.when(test(f), F.lit(f)) for f in fields)))
    inferred = named(IDENTITY_FIELDS, lambda f: stated(f) & vague(F.try_element_at("bases", F.lit(f))))
    findings = named(KEY_FINDING_FIELDS, stated)
    ambiguous = F.array_sort(F.array_distinct(F.array_intersect("quality_flags", F.array(*map(F.lit, AMBIGUOUS_MARKERS)))))
    conflicts = F.array_sort(F.array_distinct("conflicts"))
    words = lambda xs: F.array_join(xs, ", ")
    validation = F.col("validation_confidence")
    status = F.when(F.size("conflicts") > 0, "mismatch").when(validation.isNull(), "unvalidated").when(validation >= MEDIUM_BAND_FLOOR, "validated").otherwise("mismatch")
    reasons = F.array_compact(F.array(
        F.when(F.size("conflicts") > 0, F.concat(F.lit("Conflicting readings were preserved for: "), words(conflicts)))
        .when(validation < MEDIUM_BAND_FLOOR, "Claimed values could not be located in the raw extraction with sufficient agreement"),
        F.when(score.isNull() | (score < HIGH_BAND_FLOOR), f"Combined confidence is below the {HIGH_BAND_FLOOR} review threshold"),
        F.when(F.size(inferred) > 0, F.concat(F.lit("Identity or role is inferred for: "), words(inferred))),
        F.when(F.size(findings) > 0, F.concat(F.lit("Record carries key findings: "), words(findings))),
        F.when(F.lower("text").rlike("(" + "|".join(SENSITIVE_MARKERS) + ")"), "Source text contains sensitive content"),
        F.when(F.size(ambiguous) > 0, F.concat(F.lit("Source quality is degraded or incomplete: "), words(ambiguous))),
        F.when(vague(F.col("basis")), "Record meaning is contextual"),
    ))
    return records.withColumns({
        "confidence": score, "band": band_for(score), "validation_status": status, "reasons": F.concat_ws("; ", reasons), "requires_review": F.size(reasons) > 0,
    })


def reconcile(local: DataFrame, hosted: DataFrame) -> DataFrame:
    """Two outputs (record_id, field, value, validation): the higher validation wins, a tie stays local; conflicts are flagged."""
    h = hosted.select("record_id", "field", F.col("value").alias("other"), F.col("validation").alias("other_validation"))
    joined = local.join(h, ["record_id", "field"], "full_outer")
    take = F.col("value").isNull() | (F.coalesce("other_validation", F.lit(-1.0)) > F.coalesce("validation", F.lit(-1.0)))
    return joined.select("record_id", "field", F.when(take, F.col("other")).otherwise(F.col("value")).alias("value"),
                         F.coalesce(F.col("value") != F.col("other"), F.lit(False)).alias("conflict"))


def escalation(records: DataFrame, below: float = ESCALATE_BELOW, hosted_only: bool = False) -> DataFrame:
    """Why a record should go to the second model: escalation_reasons, empty where it need not. records: forced (a reviewer asked),
    local_status (null: no local model; failed, rejected or succeeded), local (whether there is a result), validation_confidence,
    conflicts[], ungrounded[] and quality_flags[]."""
    words = lambda c: F.array_join(c, ", ")
    degraded = F.array_sort(F.array_distinct(F.array_intersect("quality_flags", F.array(*map(F.lit, DEGRADED_FLAGS)))))
    status, validation, local = F.col("local_status"), F.col("validation_confidence"), F.col("local")
    reasons = F.array_compact(F.array(
        F.when(F.col("forced"), "A reviewer requested re-analysis"),
        F.when(F.lit(hosted_only), "Routing mode sends evidence directly to the second model"),
        F.when(status.isNull(), "No local model is configured").when(status == "failed", "The local model was unavailable or returned an error")
        .when(status == "rejected", "The local output failed validation"),
        F.when(local & validation.isNull(), "The local result could not be validated")
        .when(local & (validation < below), F.concat(F.lit("Local validation confidence "), F.format_number(validation, 2), F.lit(f" is below {below:.2f}"))),
        F.when(local & (F.size("conflicts") > 0), F.concat(F.lit("The local model conflicts with parser values for: "), words("conflicts"))),
        F.when(local & (F.size("ungrounded") > 0), F.concat(F.lit("The local model cited unsupported values for: "), words("ungrounded"))),
        F.when(F.size(degraded) > 0, F.concat(F.lit("The source is visually degraded: "), words(degraded))),
    ))
    return records.withColumn("escalation_reasons", reasons)


def event_type(role: Column, stated: Column, amount: Column) -> Column:
    return (
        F.when(role == "balance", "observed_balance").when(stated.isNotNull(), F.substring(stated, 1, 80))
        .when(amount.isNull(), "observed_record").otherwise("financial_transaction")
    )


def project_events(records: DataFrame) -> DataFrame:
    """One event a record: event_id (of the record), type, description (4000 characters at most), at."""
    text = F.concat_ws(" - ", F.col("stated_type"), F.trim("text"))
    return records.select(
        "case_id", "record_id", F.substring(F.sha2(F.concat_ws("\x1f", F.lit("event"), F.col("record_id").cast("string")), 256), 1, 36).alias("event_id"),
        event_type(F.col("amount_role"), F.col("stated_type"), F.col("amount")).alias("event_type"), F.substring(text, 1, 4000).alias("description"), "at",
    )


def project_transactions(records: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Records that state money that moved. With the existing rows (record_id, amount, reviewed): what becomes of each - `action`
    create, refresh (unreviewed ones take the record's amount), keep (reviewed) or withdraw (unreviewed ones whose record now states
    a balance or nothing) - and the amount it leaves."""
    moved = records.where(F.col("amount").isNotNull() & is_transactional(F.col("amount_role")))
    if existing is None:
        return moved
    old = existing.select(F.col("record_id").alias("_r"), F.col("amount").alias("_a"), "reviewed")
    both = moved.select("record_id", "amount").join(old, F.col("record_id") == F.col("_r"), "full_outer")
    action = F.when(F.col("_r").isNull(), "create").when(F.col("reviewed"), "keep").when(F.col("record_id").isNull(), "withdraw").otherwise("refresh")
    left = F.when(action == "withdraw", None).when(action == "keep", F.col("_a")).otherwise(F.col("amount"))
    return both.select(F.coalesce("record_id", "_r").alias("record_id"), action.alias("action"), left.alias("amount"))


# Attribute of a record, the relation it states.
STATED_ROLES = {"stated_vehicle_use": "USED_VEHICLE", "stated_presence": "LOCATED_AT", "stated_vehicle_presence": "LOCATED_AT"}


def role_edges(records: DataFrame) -> DataFrame:
    """Directed relations of the pairs that records state in one sentence: case_id, record_id and the arrays of STATED_ROLES, each
    array<struct<a,b>> or absent."""
    none = F.array().cast("array<struct<a:string,b:string>>")
    parts = [
        F.transform(F.coalesce(F.col(name), none), _stated(kind))
        for name, kind in STATED_ROLES.items()
        if name in records.columns
    ]
    rows = records.select("case_id", "record_id", F.explode(F.concat(*parts)).alias("p"))
    out = rows.select("case_id", "record_id", F.col("p.a").alias("subject"), F.col("p.b").alias("object"), F.col("p.kind").alias("relation_type"))
    return out.where("subject <> object").distinct()


def _stated(kind: str):
    return lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(kind).alias("kind"))


def sentence_links(units: DataFrame, left, right, verbs: str) -> DataFrame:
    """Pairs of two extractions that stand in one sentence with a verb: unit_id, a, b, sentence (the first). left and right take the
    sentence's column. Both are made once a sentence, the right where there is a left: a filter on them would make them anew."""
    once = lambda value, of: F.get(F.transform(F.array(value), of), F.lit(0))
    pair = lambda ls, rs: F.flatten(F.transform(ls, lambda a: F.transform(rs, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    s = units.select("unit_id", F.posexplode(ids.sentences(F.col("text"))).alias("i", "sentence")).where(F.col("sentence").rlike(verbs))
    both = once(left(F.col("sentence")), lambda ls: F.when(F.size(ls) > 0, once(right(F.col("sentence")), lambda rs: pair(ls, rs))))
    pairs = s.select("unit_id", "i", "sentence", F.explode(both).alias("p")).select("unit_id", "i", "sentence", "p.a", "p.b")
    return pairs.groupBy("unit_id", "a", "b").agg(F.min_by("sentence", "i").alias("sentence"))


def person_vehicle_links(units: DataFrame) -> DataFrame:
    from ..functions import moments as m

    return sentence_links(units, m.find_person_names, ids.find_vehicle_identifiers, m.DRIVING_VERB)


def vehicle_location_links(units: DataFrame) -> DataFrame:
    from ..functions import moments as m

    return sentence_links(units, ids.find_vehicle_identifiers, m.find_locations, m.PRESENCE_VERB)


def person_location_links(units: DataFrame) -> DataFrame:
    from ..functions import moments as m

    return sentence_links(units, m.find_person_names, m.find_locations, m.PRESENCE_VERB)


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The last review decision of each subject and the status it gives: rejected alerts are dismissed, others reviewed."""
    best = decisions.groupBy("subject_type", "subject_id").agg(F.max_by("decision", F.struct("at", "decision_id")).alias("decision"))
    status = F.when((F.col("subject_type") == "alert") & (F.col("decision") == "rejected"), "dismissed").when(F.col("subject_type") == "alert", "reviewed").otherwise(F.col("decision"))
    return best.withColumn("status", status)
