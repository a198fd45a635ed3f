"""Joins between cases, entities, records and evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weights of shared fields, tolerances.
MATCH_WEIGHT = {"reference": 0.90, "device": 0.86, "account": 0.85, "email": 0.80, "phone": 0.78}
AMOUNT_TOLERANCE, CONTRADICTION_S, CONTRADICTION_CONFIDENCE = 0.01, 86_400, 0.8
SEMANTIC_S, SEMANTIC_CONFIDENCE = 6 * 3_600, 0.45


#: Rows of a block of a busy value's holders: two blocks meet in a task.
BLOCK_ROWS = 1_024


def lookup_label(rows: DataFrame, key: str, names: DataFrame, name_key: str, label: str, default: str) -> DataFrame:
    """rows with `label` looked up, or the default. A key that names repeats takes its smallest label."""
    one = names.groupBy(F.col(name_key).alias("_k")).agg(F.min(label).alias("_label"))
    return rows.join(one, F.col(key) == F.col("_k"), "left").withColumn(label, F.coalesce("_label", F.lit(default))).drop("_k", "_label")


def visible_cases(cases: DataFrame, members: DataFrame, user) -> DataFrame:
    """case_ids that a user owns or is a member of."""
    owned = cases.where(F.col("owner_id") == user).select("case_id")
    return owned.union(members.where(F.col("user_id") == user).select("case_id")).distinct()


def cross_case(entities: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Keys that occur in more than one case, from each case's side: case_id, linked_case, entity_type, key.

    entities: case_id, entity_type, key (unrejected). Copies of a key inside a case collapse first, so a key of k
    cases gives k * (k - 1) rows and no more."""
    one = entities.select("case_id", "entity_type", "key").distinct()
    other = one.join(visible, "case_id", "left_semi") if visible is not None else one
    other = other.select(F.col("case_id").alias("linked_case"), F.col("entity_type").alias("_t"), F.col("key").alias("_k"))
    same = (F.col("entity_type") == F.col("_t")) & (F.col("key") == F.col("_k")) & (F.col("case_id") != F.col("linked_case"))
    return one.join(other, same).select("case_id", "linked_case", "entity_type", "key")


#: Types by which cases are matched.
MATCHABLE = ("phone", "email", "upi", "account", "ifsc", "reference", "url", "vehicle", "device", "upi_id", "account_number", "utr")


def matchable(entities: DataFrame) -> DataFrame:
    """Unrejected entities of a type by which cases are matched. entities: entity_type, status."""
    return entities.where(F.col("entity_type").isin(*MATCHABLE) & (F.coalesce("status", F.lit("")) != "rejected"))


def prior_records(entities: DataFrame, priors: DataFrame) -> DataFrame:
    """Each entity's prior records, the newest first (`rank`); an entity without a key is not looked up. entities: entity_id,
    entity_type, key; priors: identifier_type, identifier_value, record_reference, registered_on.

    The records of a value are ranked once, before they meet its entities: pairs, which are the result, are neither shuffled nor
    sorted. Only the pairs of an entity that has several rows are ranked as pairs."""
    on = (F.col("entity_type") == F.col("identifier_type")) & (F.col("key") == F.col("identifier_value"))
    order = (F.desc_nulls_first("registered_on"), F.asc("record_reference"))
    out = ("entity_id", "record_reference", "registered_on", "rank")
    # few bytes of entities can have very many pairs: they are dealt out by number, not by size
    dealt = entities.where("key IS NOT NULL").repartition(4 * entities.sparkSession.sparkContext.defaultParallelism, "entity_id")
    held = dealt.withColumn("_n", F.count("*").over(Window.partitionBy("entity_id")))
    ranked = priors.withColumn("rank", F.row_number().over(Window.partitionBy("identifier_type", "identifier_value").orderBy(*order)))
    one = held.where("_n = 1").join(ranked, on).select(*out)
    several = held.where("_n > 1").join(priors, on).withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(*order)))
    return one.unionByName(several.select(*out))


def correlate(*candidates: DataFrame) -> DataFrame:
    """Candidates of several rules (case_id, left, right, relation_type, fields, confidence), each key once, with its key: the first
    48 hexadecimal digits of the SHA-256 of relation type, fields and both records."""
    every = reduce(DataFrame.unionByName, candidates)
    text = F.concat_ws("\x1f", "relation_type", "fields", F.col("left").cast("string"), F.col("right").cast("string"))
    keyed = every.withColumn("key", F.substring(F.sha2(text, 256), 1, 48))
    best = keyed.groupBy("case_id", "key").agg(F.max(F.struct("confidence", "relation_type", "fields", "left", "right")).alias("b"))
    return best.select("case_id", "b.*", "key").orderBy(F.desc("confidence"), "relation_type", "key")


def rank_links(links: DataFrame, limit: int = 80) -> DataFrame:
    """A case's links, strongest first, `limit` a case: high before medium, then label and linked case."""
    w = Window.partitionBy("case_id").orderBy(F.when(F.col("confidence") == "high", 0).otherwise(1), "label", "linked_case")
    ranked = links.dropDuplicates(["case_id", "signal", "label", "linked_case"])
    return ranked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def shared_values(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(case_id, evidence_id, record_id, field, value) of the identifier columns: trimmed, lower case, one row each.
    fields: column -> kind in MATCH_WEIGHT."""
    kinds = {f.name: f.dataType.typeName() for f in records.schema.fields}
    out = None
    for c, kind in fields.items():
        p = F.col(c) if kinds[c] == "array" else F.array(F.col(c))
        rows = records.select("case_id", "evidence_id", "record_id", F.lit(kind).alias("field"), F.explode(p).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    value = F.lower(F.trim(F.col("value").cast("string")))
    return out.withColumn("value", value).where("value <> ''").distinct()


def pairs_within(rows: DataFrame, keys: list[str], id_col: str, most: int = BLOCK_ROWS) -> DataFrame:
    """keys, a, b: each pair of rows (as structs, a's id the smaller) that share all keys, once. Rows with equal ids are no pair.

    The holders of a key are dealt to blocks of about `most` rows, and each pair of blocks meets under a key of its own: a value
    that very many rows share spreads over as many tasks as it has pairs of blocks, and no task sees more than two blocks of it."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / most).cast("int").alias("_g"))
    dealt = rows.join(n, keys).withColumn("_k", F.pmod(F.xxhash64(id_col), F.col("_g")).cast("int"))
    row = F.struct(*(F.col(c) for c in rows.columns))
    a = dealt.select(*keys, row.alias("a"), F.col("_k").alias("_i"), F.explode(F.sequence(F.col("_k"), F.col("_g") - 1)).alias("_j"))
    b = dealt.select(*keys, row.alias("b"), F.explode(F.sequence(F.lit(0), F.col("_k"))).alias("_i"), F.col("_k").alias("_j"))
    ia, ib = F.col(f"a.{id_col}"), F.col(f"b.{id_col}")
    both = a.join(b, [*keys, "_i", "_j"]).where(((F.col("_i") < F.col("_j")) & (ia != ib)) | (ia < ib))
    return both.select(*keys, F.when(ia < ib, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ia < ib, F.col("b")).otherwise(F.col("a")).alias("b"))


def exact_matches(values: DataFrame) -> DataFrame:
    """Pairs of records of one case and different evidence that share a value: case_id, left, right, fields, confidence.

    An inverted-index join: records meet under a shared value alone, those of a busy value block by block. The pairs are the
    result, one row each; where a value's holders are too many for that, see value_classes."""
    weight = F.coalesce(*(F.when(F.col("field") == k, F.lit(w)) for k, w in MATCH_WEIGHT.items()), F.lit(0.0))
    pairs = pairs_within(values.select("case_id", "field", "value", "record_id", "evidence_id"), ["case_id", "field", "value"], "record_id")
    pairs = pairs.where(F.col("a.evidence_id") != F.col("b.evidence_id"))
    return pairs.groupBy("case_id", F.col("a.record_id").alias("left"), F.col("b.record_id").alias("right")).agg(
        F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"), F.max(weight).alias("confidence")
    )


def value_classes(values: DataFrame, least: int = 2) -> DataFrame:
    """The matches of a value with `least` records or more as a class: case_id, field, value, records, evidence, pairs (of records
    with different evidence) and confidence. Who belongs to it are the value's rows; the pairs are counted and not made."""
    per = values.groupBy("case_id", "field", "value", "evidence_id").agg(F.count_distinct("record_id").alias("n"))
    total = per.groupBy("case_id", "field", "value").agg(F.sum("n").alias("records"), F.count("*").alias("evidence"), F.sum(F.col("n") * F.col("n")).alias("same"))
    weight = F.coalesce(*(F.when(F.col("field") == k, F.lit(w)) for k, w in MATCH_WEIGHT.items()), F.lit(0.0))
    pairs = ((F.col("records") * F.col("records") - F.col("same")) / 2).cast("long").alias("pairs")
    return total.where(F.col("records") >= least).select("case_id", "field", "value", "records", "evidence", pairs, weight.alias("confidence"))


def contradictions(records: DataFrame) -> DataFrame:
    """Pairs with one reference and different evidence whose amount, currency or time disagree: case_id, left, right,
    fields, confidence. records: case_id, record_id, evidence_id, reference, amount, currency, at."""
    held = records.select("case_id", F.lower(F.trim("reference")).alias("ref"), "record_id", "evidence_id", "amount", "currency", "at").where("ref <> ''")
    pairs = pairs_within(held, ["case_id", "ref"], "record_id").where(F.col("a.evidence_id") != F.col("b.evidence_id"))
    gap = F.abs(F.timestamp_diff("SECOND", F.col("a.at"), F.col("b.at")))
    fields = F.array_compact(
        F.array(
            F.when(F.abs(F.col("a.amount") - F.col("b.amount")) > AMOUNT_TOLERANCE, "amount"),
            F.when(F.col("a.currency") != F.col("b.currency"), "currency"),
            F.when(gap > CONTRADICTION_S, "event_time"),
        )
    )
    return pairs.withColumn("f", fields).where(F.size("f") > 0).select(
        "case_id", F.col("a.record_id").alias("left"), F.col("b.record_id").alias("right"), F.array_join("f", ",").alias("fields"),
        F.lit(CONTRADICTION_CONFIDENCE).alias("confidence"),
    )


def semantic_candidates(
    records: DataFrame, values: DataFrame | None = None, tolerance: float = AMOUNT_TOLERANCE, within_s: int = SEMANTIC_S
) -> DataFrame:
    """Pairs of a case and different evidence with amounts within `tolerance` and times within `within_s`, found in
    buckets of both, that share no identifier: case_id, left, right, confidence. records: case_id, record_id, evidence_id, amount, at;
    values: as of shared_values. Only the pairs found meet under their values, not all pairs that share one."""
    money = F.floor(F.col("amount") / (2 * tolerance))  # wide enough for the division's rounding
    day = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at")) / within_s)
    a = records.select("case_id", F.col("record_id").alias("left"), F.col("evidence_id").alias("_ea"), "amount", "at", money.alias("m"), day.alias("d"))
    steps = F.array(*(F.lit(x) for x in (-1, 0, 1)))
    b = records.select(
        F.col("case_id").alias("_c"), F.col("record_id").alias("right"), F.col("evidence_id").alias("_eb"), F.col("amount").alias("_amount"),
        F.col("at").alias("_at"), money.alias("_m0"), day.alias("_d0"),
    ).withColumn("_dm", F.explode(steps)).withColumn("_dd", F.explode(steps))
    on = (F.col("case_id") == F.col("_c")) & (F.col("m") == F.col("_m0") + F.col("_dm")) & (F.col("d") == F.col("_d0") + F.col("_dd"))
    near = (F.abs(F.col("amount") - F.col("_amount")) <= tolerance) & (F.abs(F.timestamp_diff("SECOND", F.col("at"), F.col("_at"))) <= within_s)
    pairs = a.join(b, on & (F.col("left") < F.col("right")) & (F.col("_ea") != F.col("_eb")) & near)
    pairs = pairs.select("case_id", "left", "right")
    if values is not None:
        side = lambda c: values.select(F.col("case_id").alias("_c"), F.col("record_id").alias(f"_{c}"), F.col("field").alias(f"_f{c}"), F.col("value").alias(f"_v{c}"))
        held = pairs.join(side("l"), (F.col("case_id") == F.col("_c")) & (F.col("left") == F.col("_l"))).drop("_c")
        both = held.join(
            side("r"), (F.col("case_id") == F.col("_c")) & (F.col("right") == F.col("_r")) & (F.col("_fl") == F.col("_fr")) & (F.col("_vl") == F.col("_vr"))
        )
        pairs = pairs.join(both.select("case_id", "left", "right").distinct(), ["case_id", "left", "right"], "left_anti")
    return pairs.withColumn("confidence", F.lit(SEMANTIC_CONFIDENCE))


def fill_sibling(rows: DataFrame, siblings: DataFrame, fields: list[str]) -> DataFrame:
    """rows with their null `fields` filled from siblings of the same evidence whose amount lies within the tolerance; each field
    from the first sibling by id that has it, of siblings with one id the smallest value. Reviewed rows stay as they are, rows that repeat an id are told apart by amount. rows: evidence_id, amount, id, reviewed and the
    fields; siblings: the same without reviewed."""
    open_ = F.array(*map(F.col, fields))
    needy = rows.where(~F.col("reviewed") & F.exists(open_, lambda x: x.isNull()))
    step = F.floor(F.col("amount") / (2 * AMOUNT_TOLERANCE)).cast("long")  # wide enough for the division's rounding
    a = needy.select(F.col("evidence_id").alias("_e"), F.col("id").alias("_i"), F.col("amount").alias("_a"), F.explode(F.array(step - 1, step, step + 1)).alias("_m"))
    b = siblings.withColumn("_s", step)
    near = a.join(b, (F.col("evidence_id") == F.col("_e")) & (F.col("_s") == F.col("_m")) & (F.abs(F.col("amount") - F.col("_a")) <= AMOUNT_TOLERANCE + 1e-9))
    best = near.groupBy("_e", "_i", "_a").agg(*(F.min(F.when(F.col(f).isNotNull(), F.struct("id", f))).getField(f).alias(f"_{f}") for f in fields))
    out = rows.join(best, (F.col("evidence_id") == F.col("_e")) & (F.col("id") == F.col("_i")) & (F.col("amount") == F.col("_a")) & ~F.col("reviewed"), "left")
    return out.withColumns({f: F.coalesce(f, f"_{f}") for f in fields}).select(*rows.columns)


def purge_orphans(events: DataFrame, records: DataFrame, transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events whose record is still there, and transactions whose event is (or that name none)."""
    kept = events.join(records.select("record_id"), "record_id", "left_semi")
    gone = transactions.where("event_id IS NOT NULL").join(kept.select("event_id"), "event_id", "left_anti")
    return kept, transactions.join(gone.select("txn_id"), "txn_id", "left_anti")
