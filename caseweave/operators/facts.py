"""Facts of units: identifiers with their confidence, cells of tables, report headers, blocks of images, older parsers' events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, moments
from ..functions import identifiers as ids
from . import records

# How sure a reading of each kind is; amounts without a currency are less so.
CONFIDENCE = {
    "phone_numbers": 0.94, "email_addresses": 0.95, "account_identifiers": 0.93, "transaction_reference": 0.95, "device_identifier": 0.92,
    "vehicle_identifiers": 0.93, "organisation_names": 0.80, "person_names": 0.75, "person_roles": 0.75, "location_names": 0.65, "amount": 0.96,
}
BARE_AMOUNT = 0.82
HEADER_CONFIDENCE = {"fir_number": 0.97, "fir_sections": 0.94, "police_station": 0.95}
LINK_CONFIDENCE = {"stated_vehicle_use": 0.82, "stated_presence": 0.78, "stated_vehicle_presence": 0.80}
CELL_CONFIDENCE = {"amount": 0.98, "event_time": 0.98, "event_time_precision": 0.98, "narration": 0.99, "phone_numbers": 0.96, "email_addresses": 0.96, "account_identifiers": 0.96}
CELL_DEFAULT = 0.97
BLOCK_AMOUNT, BLOCK_BARE_AMOUNT, BLOCK_REFERENCE = 0.94, 0.80, 0.93
INDICATOR_FIELDS = {
    "phone": "phone_numbers", "email": "email_addresses", "upi_id": "account_identifiers", "ifsc": "account_identifiers",
    "account_number": "account_identifiers", "utr": "transaction_reference", "upi": "account_identifiers", "account": "account_identifiers",
    "reference": "transaction_reference", "device": "device_identifier", "party": "sender", "person": "person_names",
    "organisation": "organisation_names", "location": "location_names", "vehicle": "vehicle_identifiers",
}
OLD_AMOUNT = r"(?i)(?:₹|INR|RS\.?|AMOUNT\s*[:=-]?)\s*([0-9][0-9,]*(?:\.\d{1,2})?)"
OLD_TIMES = [
    r"\b\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?\b",
    r"(?i)\b\d{2}[/-]\d{2}[/-]\d{4}[, ]+\d{1,2}:\d{2}(?::\d{2})?(?:\s?[AP]M)?\b",
    r"\b\d{2}[/-]\d{2}[/-]\d{4}\b",
]


def _facts(pairs: list[tuple[str, Column, Column]]) -> Column:
    """array<struct<kind, value, confidence>> of the pairs that have a value."""
    one = lambda k, v, c: F.when(F.coalesce(v, F.lit("")) != "", F.struct(F.lit(k).alias("kind"), v.alias("value"), c.cast("double").alias("confidence")))
    return F.array_compact(F.array(*(one(*p) for p in pairs)))


def plain(number: Column) -> Column:
    """A number with two decimals and no grouping."""
    return F.when(number.isNotNull(), F.format_string("%.2f", number))


#: Rows of a scan that one task takes, about, where each is costly to read.
SPREAD_ROWS = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """rows of a plain scan, dealt out to one task a core at least and one for each SPREAD_ROWS: what a scan gives a task is a
    row group, however many rows that has."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // SPREAD_ROWS)))


def identifier_facts(units: DataFrame) -> DataFrame:
    """unit_id, kind, value, confidence of what a unit's text states; several values of a kind are joined by comma and blank.

    Patterns are tried on texts that hold what every match holds, and each reading is a column of its own, made once."""
    t = F.col("text")
    listed = lambda c: F.array_join(c, ", ")
    sure = lambda k: F.lit(CONFIDENCE[k])
    digit = lambda c: F.when(t.rlike(r"\d"), c)
    found = units.withColumns({"_a": moments.find_amount_detail(t), "_p": moments.people(t)})
    readings = {
        "phone_numbers": digit(listed(ids.find_phone_numbers(t))), "email_addresses": listed(ids.find_email_addresses(t)), "account_identifiers": listed(ids.find_account_identifiers(t)),
        "transaction_reference": ids.find_transaction_reference(t), "device_identifier": ids.find_device_identifier(t), "vehicle_identifiers": digit(listed(ids.find_vehicle_identifiers(t))),
        "organisation_names": listed(ids.find_organisations(t)), "person_names": listed(moments.find_person_names(t, F.col("_p"))),
        "person_roles": F.array_join(F.transform(moments.find_person_roles(t, F.col("_p")), lambda x: F.concat_ws(": ", x["name"], x["role"])), ", "), "location_names": listed(moments.find_locations(t)),
    }
    found = found.withColumns({f"_{k}": v for k, v in readings.items()})
    facts = _facts([
        *((k, F.col(f"_{k}"), sure(k)) for k in readings),
        ("amount", plain(F.col("_a.value")), F.when(F.col("_a.currency").isNull(), BARE_AMOUNT).otherwise(CONFIDENCE["amount"])),
    ])
    return found.select("unit_id", F.explode(facts).alias("x")).select("unit_id", "x.*")


def cell_facts(cells: DataFrame) -> DataFrame:
    """unit_id, kind, value, confidence of table cells (unit_id, field, raw): the header has said what a cell is."""
    raw, field = F.col("raw"), F.col("field")
    found = cells.withColumns({"_a": moments.find_amount_detail(raw, declared_monetary=True), "_t": moments.find_timestamp(raw)})
    when = lambda name, value: F.when(field == name, value)
    is_time = (field == "event_time") & F.col("_t.at").isNotNull()
    same = ~field.isin("amount", "event_time", "phone_numbers", "email_addresses", "account_identifiers")
    value = F.coalesce(
        when("amount", plain(F.col("_a.value"))), F.when(is_time, F.date_format("_t.at", "yyyy-MM-dd'T'HH:mm:ss")),
        when("phone_numbers", canonical.normalize_identifier("phone", raw)), when("email_addresses", canonical.normalize_identifier("email", raw)),
        when("account_identifiers", canonical.normalize_identifier("account_number", raw)), F.when(same, raw),
    )
    sure = F.lit(CELL_DEFAULT)
    for name, c in CELL_CONFIDENCE.items():
        sure = F.when(field == name, c).otherwise(sure)
    rows = F.array_compact(F.array(
        F.when(value.isNotNull(), F.struct(field.alias("kind"), value.alias("value"), sure.alias("confidence"))),
        F.when(is_time, F.struct(F.lit("event_time_precision").alias("kind"), F.col("_t.precision").alias("value"), F.lit(CELL_CONFIDENCE["event_time_precision"]).alias("confidence"))),
    ))
    return found.select("unit_id", F.explode(rows).alias("x")).select("unit_id", "x.*")


def report_enrichment(documents: DataFrame, units: DataFrame) -> DataFrame:
    """unit_id, kind, value, confidence: a report's header facts at its first unit, and the pairs that single sentences of a unit
    state (`a > b`). documents: evidence_id, text; units: evidence_id, unit_id, text."""
    t = F.col("text")
    sure = lambda k: F.lit(HEADER_CONFIDENCE[k])
    readings = {"fir_number": ids.find_fir_number(t), "fir_sections": F.array_join(moments.find_fir_sections(t), ", "), "police_station": moments.find_police_station(t)}
    header = _facts([(k, F.col(f"_{k}"), sure(k)) for k in readings])
    first = units.groupBy("evidence_id").agg(F.min("unit_id").alias("unit_id"))
    out = documents.select("evidence_id", *(v.alias(f"_{k}") for k, v in readings.items())).select("evidence_id", F.explode(header).alias("x")).join(first, "evidence_id").select("unit_id", "x.*")
    links = {"stated_vehicle_use": records.person_vehicle_links, "stated_presence": records.person_location_links, "stated_vehicle_presence": records.vehicle_location_links}
    for kind, find in links.items():
        pairs = find(units).select("unit_id", F.lit(kind).alias("kind"), F.concat_ws(" > ", "a", "b").alias("value"), F.lit(LINK_CONFIDENCE[kind]).alias("confidence"))
        out = out.unionByName(pairs)
    return out


def block_scoped_facts(blocks: DataFrame, key: str) -> DataFrame:
    """Per key the first block that states an amount and the first that states a reference: key, kind, value, place, confidence.
    blocks: key, place, text."""
    found = blocks.withColumns({"_a": moments.find_amount_detail(F.col("text")), "_r": ids.find_transaction_reference(F.col("text"))})
    sure = F.when(F.col("_a.currency").isNull(), BLOCK_BARE_AMOUNT).otherwise(BLOCK_AMOUNT)
    form = "struct<kind:string,value:string,confidence:double>"
    amount = F.when(F.col("_a").isNotNull(), F.struct(F.lit("amount"), plain(F.col("_a.value")), sure).cast(form))
    reference = F.when(F.col("_r").isNotNull(), F.struct(F.lit("transaction_reference"), F.col("_r"), F.lit(BLOCK_REFERENCE)).cast(form))
    rows = found.select(key, "place", F.explode(F.array_compact(F.array(amount, reference))).alias("x")).select(key, "place", "x.*")
    best = rows.groupBy(key, "kind").agg(F.min(F.struct("place", "value", "confidence")).alias("b"))
    return best.select(key, "kind", "b.value", "b.place", "b.confidence")


def field_reference(provenance: Column, fields: list[str], record: Column) -> Column:
    """The narrowest reference of the fields behind an edge: the first that has one, else the record's. provenance: map of field to
    reference."""
    return F.coalesce(*(F.nullif(F.try_element_at(provenance, F.lit(f)), F.lit("")) for f in fields), record)


def canonicalize_indicator(entity_type: Column, value: Column) -> Column:
    """struct<entity_type, display, key> of an older parser's indicator, or null for types that name no party."""
    out = None
    for kind, field in INDICATOR_FIELDS.items():
        node = canonical.canonicalize(field, value)
        out = F.when(entity_type == kind, node) if out is None else out.when(entity_type == kind, node)
    return out


def extract_timestamp(text: Column) -> Column:
    """struct<at, quote, precision (minute, day or unknown)> of the older parser: the first of its three forms that is a time."""
    quotes = [F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 0), F.lit("")) for p in OLD_TIMES]
    read = [(moments.find_timestamp(q)["at"], q) for q in quotes]
    out = None
    for at, quote in read:
        hit = F.struct(at.alias("at"), quote.alias("quote"), F.when(quote.contains(":"), "minute").otherwise("day").alias("precision"))
        out = F.when(at.isNotNull(), hit) if out is None else out.when(at.isNotNull(), hit)
    return out.otherwise(F.struct(F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(None).cast("string").alias("quote"), F.lit("unknown").alias("precision")))


def extract_transaction_fields(text: Column, columns: Column) -> Column:
    """struct<amount, sender, receiver, reference>: from named columns (map, keys in lower case), else the amount from the text."""
    first = lambda *names: F.coalesce(*(F.nullif(F.try_element_at(columns, F.lit(n)), F.lit("")) for n in names))
    source = F.coalesce(F.concat(F.lit("INR "), first("amount", "value")), text, F.lit(""))
    amount = F.regexp_replace(F.regexp_extract(source, OLD_AMOUNT, 1), ",", "").try_cast("double")
    return F.struct(
        amount.alias("amount"), first("sender", "from").alias("sender"), first("receiver", "to", "beneficiary").alias("receiver"),
        first("reference", "reference_id", "utr", "transaction_id").alias("reference"),
    )


def events_from_records(rows: DataFrame) -> DataFrame:
    """One event for each record of three characters or more: evidence_id, record_id, event_type, at, precision, amount, sender,
    receiver, reference, description (4,000 characters at most), confidence. rows: evidence_id, record_id, record_type, text, columns."""
    kept = rows.where(F.length(F.trim("text")) >= 3).withColumns({"_t": extract_timestamp(F.col("text")), "_x": extract_transaction_fields(F.col("text"), F.col("columns"))})
    bank = F.col("record_type") == "bank_transaction"
    kind = F.when(bank | F.col("_x.amount").isNotNull(), "financial_transaction").otherwise(F.col("record_type"))
    return kept.select(
        "evidence_id", "record_id", kind.alias("event_type"), F.col("_t.at").alias("at"), F.col("_t.precision").alias("precision"), "_x.amount",
        F.lower(F.trim("_x.sender")).alias("sender"), F.lower(F.trim("_x.receiver")).alias("receiver"), "_x.reference",
        F.substring("text", 1, 4000).alias("description"), F.when(bank, 0.91).otherwise(0.78).alias("confidence"),
    )


def ocr_document_events(rows: DataFrame, least: int = 4000) -> DataFrame:
    """One event for each image: evidence_id, lines, description (its lines in order, 4,000 characters at most), confidence. Only the
    first `least` lines can reach the description, so no more are gathered. rows: evidence_id, line, text."""
    from pyspark.sql import Window

    kept = rows.where(F.trim("text") != "").withColumn("_n", F.row_number().over(Window.partitionBy("evidence_id").orderBy("line")))
    out = kept.groupBy("evidence_id").agg(
        F.count("*").alias("lines"),
        F.array_sort(F.collect_list(F.when(F.col("_n") <= least, F.struct("line", F.trim("text").alias("text"))))).alias("t"),
    )
    joined = F.array_join(F.transform("t", lambda x: x["text"]), "\n")
    return out.select("evidence_id", "lines", F.substring(joined, 1, 4000).alias("description"), F.lit(0.78).alias("confidence"))


def response_cache(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """requests (cache_key) with the payload of the newest run of that key that succeeded: payload (null where there is none), cached."""
    good = runs.where("status = 'succeeded' AND payload IS NOT NULL")
    best = good.groupBy(F.col("cache_key").alias("_k")).agg(F.max_by("payload", F.struct("created_at", "run_id")).alias("payload"))
    return requests.join(best, F.col("cache_key") == F.col("_k"), "left").drop("_k").withColumn("cached", F.col("payload").isNotNull())


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
