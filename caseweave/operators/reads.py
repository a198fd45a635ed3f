"""What readers see: connections in words, profiles, drafts, routes of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from . import textindex

# Names of identifier kinds, what a match does not show, keywords of questions, requestable kinds.
KIND_LABELS = {
    "phone": "phone number", "email": "email address", "upi": "UPI handle", "account": "account identifier", "ifsc": "bank branch code",
    "reference": "transaction reference", "device": "device identifier", "vehicle": "vehicle registration", "organisation": "organisation name",
    "person": "person name", "location": "location", "party": "name",
}
CAVEATS = {
    "party": "A shared name is weak evidence of a shared person and needs confirmation.",
    "person": "A shared name is weak evidence of a shared person. Two people can have the same name; confirm identity before treating this as a link.",
    "organisation": "Organisation names are abbreviated and reused. Confirm this is the same entity before relying on the link.",
    "location": "A shared location links the records to a place, not to each other. Thousands of unrelated people share a place.",
    "vehicle": "This is an exact registration match. It links the records to one vehicle, not to whoever was driving it.",
}
CAVEAT = "This is an exact identifier match. It links the files, not the people behind them."
INTENT_KEYWORDS = [
    ("connection", ("connect", "link", "related", "relationship", "between", "path", "tie", "associate")),
    ("importance", ("important", "influential", "central", "key", "bridge", "matters", "priority")),
    ("chronology", ("before", "after", "when", "timeline", "chronolog", "incident", "sequence", "burst")),
    ("alerts", ("alert", "lead", "flag", "pattern", "unusual", "suspicious")),
    ("evidence", ("evidence", "file", "source", "document", "upload")),
    ("entity", ("who", "what do we know", "tell me about", "profile", "details")),
]
CLOCK_QUESTION = r"(?i)\b(?:(?:[01]?\d|2[0-3])\s*[:.]\s*[0-5]\d\s*(?:am|pm)?|(?:[01]?\d|2[0-3])[0-5]\d\s*(?:hrs?|hours))\b"
REQUESTABLE = ("phone", "upi", "account", "email", "device", "vehicle")


def _mapped(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def describe(bridges: DataFrame, files: DataFrame) -> DataFrame:
    """bridges (case_id, entity_type, key, n_evidence, band) in words: sentence and caveat. files: case_id, entity_type, key, name."""
    names = files.groupBy("case_id", "entity_type", "key").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("names"))
    label = F.coalesce(_mapped(KIND_LABELS, F.col("entity_type")), F.col("entity_type"))
    text = F.concat(F.lit("The "), label, F.lit(" "), F.col("key"), F.lit(" appears in "), F.col("n_evidence").cast("string"), F.lit(" evidence items: "), F.col("names"), F.lit("."))
    return bridges.join(names, ["case_id", "entity_type", "key"]).select(
        "case_id", "entity_type", "key", "band", text.alias("sentence"), F.coalesce(_mapped(CAVEATS, F.col("entity_type")), F.lit(CAVEAT)).alias("caveat")
    )


def dashed_edges(relations: DataFrame) -> DataFrame:
    """Consecutive pairs of the evidence that a weak relation lists: relation_id, left, right. relations: relation_id, evidence[]."""
    e = F.col("evidence")
    pairs = F.arrays_zip(F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0))).alias("left"), F.slice(e, 2, F.greatest(F.size(e) - 1, F.lit(0))).alias("right"))
    return relations.select("relation_id", F.explode(pairs).alias("p")).select("relation_id", F.col("p.left").alias("left"), F.col("p.right").alias("right"))


def intent(question: Column, matched: Column) -> Column:
    """What a question asks for: a clock time first, then the first group of keywords (a connection needs two names), then by the
    number of names `matched`. The question is data; nothing in it is followed."""
    q = F.lower(question)
    out = F.when(question.rlike(CLOCK_QUESTION), "time")
    for name, words in INTENT_KEYWORDS:
        said = F.lit(False)
        for w in words:
            said = said | q.contains(w)
        out = out.when(said & (matched >= 2) if name == "connection" else said, name)
    return out.when(matched >= 2, "connection").when(matched == 1, "entity").otherwise("overview")


def route(question: Column, matched: Column, out_of_scope: list[str]) -> Column:
    """Where a question about a report goes: declined (empty or out of scope), finding (F-01 cited), wording (a quoted phrase), else
    to the assistant by its intent."""
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    bad = q == ""
    for phrase in out_of_scope:
        bad = bad | q.contains(phrase)
    wording = q.rlike(r'where .*says? .*"[^"]+"|"[^"]+" .*(?:appear|mentioned|written)')
    return F.when(bad, "declined").when(q.rlike(r"\bf-\d{2,}\b"), "finding").when(wording, "wording").otherwise(F.concat(F.lit("assistant:"), intent(q, matched)))


def match(names: DataFrame, terms: DataFrame) -> DataFrame:
    """Of each term the entity it means: an exact match without case and punctuation, else the shortest that contains it; null if
    none. names: id, label; terms: term, any number of them."""
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    n = names.select("id", "label", fold(F.col("label")).alias("t"))
    t = terms.select("term", fold(F.col("term")).alias("_t")).where("_t <> ''")
    exact = t.join(n, F.col("_t") == F.col("t")).groupBy("term").agg(F.min(F.struct("label", "id")).alias("e"))
    found = textindex.containing(n, t.select(F.col("_t").alias("term")).distinct()).select(F.col("term").alias("_f"), "label", "id")
    part = found.groupBy("_f").agg(F.min(F.struct(F.length("label").alias("n"), "label", "id")).alias("p"))
    part = t.join(part, F.col("_t") == F.col("_f")).select("term", "p")
    out = terms.select("term").distinct().join(exact, "term", "left").join(part.dropDuplicates(["term"]), "term", "left")
    return out.select("term", F.coalesce("e.id", "p.id").alias("id"), F.coalesce("e.label", "p.label").alias("label"), F.col("e").isNotNull().alias("exact"))


def requisitions(relations: DataFrame, bridges: DataFrame, most: int = 12) -> DataFrame:
    """Per case the `most` identifiers to ask holders about: rank, node, observations, kinds, n_evidence, load_bearing (at the end of a
    relation whose loss splits the network), from_day and to_day (two days either side). Load-bearing ones first, then by evidence.
    relations: case_id, subject, object, relation_type, at, evidence_id; bridges: case_id, u, v."""
    ends = relations.select("case_id", F.explode(F.array("subject", "object")).alias("node"), "relation_type", "at", "evidence_id")
    a = ends.groupBy("case_id", "node").agg(
        F.count("*").alias("observations"), F.array_join(F.array_sort(F.collect_set(F.lower(F.replace("relation_type", F.lit("_"), F.lit(" "))))), ", ").alias("kinds"),
        F.count_distinct("evidence_id").alias("n_evidence"), F.date_sub(F.min("at").cast("date"), 2).alias("from_day"), F.date_add(F.max("at").cast("date"), 2).alias("to_day"),
    )
    fragile = bridges.select("case_id", F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("_f", F.lit(True))
    rows = a.join(fragile, ["case_id", "node"], "left").withColumn("load_bearing", F.coalesce("_f", F.lit(False))).drop("_f")
    w = Window.partitionBy("case_id").orderBy(F.desc("load_bearing"), F.desc("n_evidence"), "node")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def redact_all(column: Column, kind, alias: str) -> Column:
    """The alias replaced in a string, in every string of an array or map, and in nested structures."""
    name = kind.typeName()
    if name == "string":
        return scores.redact(column, alias)
    if name == "array":
        return F.transform(column, lambda x: redact_all(x, kind.elementType, alias))
    if name == "map":
        return F.transform_values(column, lambda _, v: redact_all(v, kind.valueType, alias))
    if name == "struct":
        return F.when(column.isNotNull(), F.struct(*(redact_all(column[f.name], f.dataType, alias).alias(f.name) for f in kind.fields)))
    return column


def redact_frame(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*(redact_all(F.col(f"`{f.name}`"), f.dataType, alias).alias(f.name) for f in df.schema.fields))
