"""Aggregations: relation summaries, bridging identifiers, traceability, strips and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import bridge_strength, strength_band


def relation_summary(relations: DataFrame) -> DataFrame:
    """Per directed (case_id, relation_type, subject, object), all statuses: observations, n_evidence, confidence, first_at,
    last_at, status (human_verified if any is, else rejected if any is, else machine_extracted)."""
    return relations.groupBy("case_id", "relation_type", "subject", "object").agg(
        F.count("*").alias("observations"),
        F.count_distinct("evidence_id").alias("n_evidence"),
        F.max("confidence").alias("confidence"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
        F.when(F.bool_or(F.col("status") == "human_verified"), "human_verified")
        .when(F.bool_or(F.col("status") == "rejected"), "rejected")
        .otherwise("machine_extracted")
        .alias("status"),
    )


def bridges(occurrences: DataFrame) -> DataFrame:
    """Identifiers seen in more than one evidence file of a case: case_id, entity_type, key, n_evidence, occurrences,
    confidence, strength, band."""
    out = occurrences.groupBy("case_id", "entity_type", "key").agg(
        F.count_distinct("evidence_id").alias("n_evidence"), F.count("*").alias("occurrences"), F.max("confidence").alias("confidence")
    )
    out = out.where(F.col("n_evidence") > 1)
    out = out.withColumn("strength", bridge_strength(F.col("entity_type"), F.col("n_evidence"), F.col("confidence")))
    return out.withColumn("band", strength_band(F.col("strength")))


def isolated(evidence: DataFrame, occurrences: DataFrame, found: DataFrame) -> DataFrame:
    """Evidence that no bridging identifier touches."""
    touched = occurrences.join(found.select("case_id", "entity_type", "key"), ["case_id", "entity_type", "key"], "left_semi")
    return evidence.join(touched.select("evidence_id").distinct(), "evidence_id", "left_anti")


def connection_summary(evidence: DataFrame, occurrences: DataFrame, top: int = 5) -> DataFrame:
    """Per case: evidence, connected, isolated, bridges, and the labels of its strongest bridges."""
    found = bridges(occurrences)
    rank = Window.partitionBy("case_id").orderBy(F.desc("strength"), F.desc("n_evidence"), "key", "entity_type")
    best = found.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= top).groupBy("case_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda x: x["key"]), ",").alias("strongest")
    )
    n_bridges = found.groupBy("case_id").agg(F.count("*").alias("bridges"))
    touched = occurrences.join(found, ["case_id", "entity_type", "key"], "left_semi").groupBy("case_id").agg(F.count_distinct("evidence_id").alias("connected"))
    n = evidence.groupBy("case_id").agg(F.count_distinct("evidence_id").alias("evidence"))
    zero = F.lit(0).cast("long")
    out = n.join(touched, "case_id", "left").join(n_bridges, "case_id", "left").join(best, "case_id", "left")
    connected = F.coalesce("connected", zero)
    return out.select("case_id", "evidence", connected.alias("connected"), (F.col("evidence") - connected).alias("isolated"),
                      F.coalesce("bridges", zero).alias("bridges"), F.coalesce("strongest", F.lit("")).alias("strongest"))


def connection_edges(occurrences: DataFrame, least: int = 2) -> DataFrame:
    """Solid edges from bridging identifiers to their evidence: case_id, entity_type, key, evidence_id."""
    found = bridges(occurrences).where(F.col("n_evidence") >= least).select("case_id", "entity_type", "key")
    return occurrences.join(found, ["case_id", "entity_type", "key"], "left_semi").select("case_id", "entity_type", "key", "evidence_id").distinct()


def across_sources(occurrences: DataFrame, top: int = 10) -> DataFrame:
    n = occurrences.groupBy("entity_type", "key").agg(F.count_distinct("evidence_id").alias("n_evidence")).where(F.col("n_evidence") > 1)
    return n.orderBy(F.desc("n_evidence"), "key", "entity_type").limit(top)


def traceability(rows: DataFrame, traced) -> DataFrame:
    """Per case: rows, traced ones and their percentage to one place (100 where there are none)."""
    share = F.bround(100 * F.count_if(traced) / F.nullif(F.count("*"), F.lit(0)), 1)
    return rows.groupBy("case_id").agg(F.count("*").alias("total"), F.count_if(traced).alias("traced"), F.coalesce(share, F.lit(100.0)).alias("percent"))


def transaction_strip(txns: DataFrame) -> DataFrame:
    """Per case: count, total (only of a single currency), currencies, senders, receivers and unresolved parties."""
    total = F.when(F.count_distinct("currency") <= 1, F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(28,2)"))
    return txns.groupBy("case_id").agg(
        F.count("*").alias("n"), total.alias("total"),
        F.when(F.count_distinct("currency") > 1, "Mixed currencies").otherwise(F.min("currency")).alias("currency"),
        F.count_distinct("sender").alias("senders"), F.count_distinct("receiver").alias("receivers"),
        F.count_if(F.col("sender").isNull() | F.col("receiver").isNull()).alias("unresolved"),
    )


def count_later(visits: DataFrame, facts: DataFrame, name: str) -> DataFrame:
    """visits (case_id, user_id, since, ...) with `name`: the facts (case_id, at) of the case strictly later than `since`.

    Days after the visit's are counted by a suffix sum over daily counts; the visit's own day by a running count over
    that day alone. So neither pairs of visits and facts nor a whole case meet in one task."""
    us = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c))
    day = lambda c: F.floor(us(c) / 86_400_000_000).alias("day")
    rest = visits.columns
    v = visits.select(F.struct(*rest).alias("v"), "case_id", us("since").alias("t"), day("since"), F.lit(0).alias("fact"))
    f = facts.where("at IS NOT NULL").select(F.lit(None).cast(v.schema["v"].dataType).alias("v"), "case_id", us("at").alias("t"), day("at"), F.lit(1).alias("fact"))
    later = Window.partitionBy("case_id", "day").orderBy(-F.col("t")).rangeBetween(Window.unboundedPreceding, -1)
    own = v.unionByName(f).withColumn("own", F.coalesce(F.sum("fact").over(later), F.lit(0))).where("fact = 0")
    daily = v.select("case_id", "day", "fact").unionByName(f.select("case_id", "day", "fact")).groupBy("case_id", "day").agg(F.sum("fact").alias("n"))
    after = Window.partitionBy("case_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.withColumn("after", F.coalesce(F.sum("n").over(after), F.lit(0))).select(F.col("case_id").alias("_c"), F.col("day").alias("_d"), "after")
    out = own.join(daily, F.col("case_id").eqNullSafe(F.col("_c")) & F.col("day").eqNullSafe(F.col("_d")))
    return out.select("v.*", (F.col("own") + F.col("after")).alias(name))


def whats_new(visits: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Per reader and case: rows of each fact later than the reader's last visit. facts: name -> (case_id, at)."""
    for name, rows in facts.items():
        visits = count_later(visits, rows, f"new_{name}")
    return visits


def provider_timing(runs: DataFrame) -> DataFrame:
    """Per provider and model: calls, upper median, longest and total latency, cached calls."""
    return runs.groupBy("provider", "model").agg(
        F.count("*").alias("calls"), F.expr("median(latency)").alias("median"), F.max("latency").alias("longest"),
        F.sum("latency").alias("total"), F.count_if("cached").alias("cached"),
    )


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, chosen by a map-side maximum rather than a window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def top_per(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in rest))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0, most: int = 200) -> DataFrame:
    """One page of `limit` (1 to `most`) rows; `total` is added by `counted`."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(most, max(1, limit)))
