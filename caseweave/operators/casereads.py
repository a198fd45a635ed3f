"""What a reader is shown of a case: summaries, health, stages, claims, lineage, exported findings, and how a benchmark went."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The classes that a subject should be connected to.
CLASSES = ("person", "vehicle", "location", "organisation")
HIGH_VALUE = 50_000


def _zero(name: str):
    return F.coalesce(F.col(name), F.lit(0).cast("long")).alias(name)


def entity_summary(relations: DataFrame, kinds: int = 3) -> DataFrame:
    """node, roles, relations, sources, strongest (id of the first of the surest relations), kinds (the commonest relation types) of
    every end of relations (subject, object, id, relation_type, confidence, evidence_id), whatever their status."""
    ends = F.array(*(F.struct(F.col(c).alias("node"), F.lit(c).alias("role")) for c in ("subject", "object")))
    e = relations.select(F.explode(ends).alias("x"), "id", "relation_type", "confidence", "evidence_id").select("x.*", "id", "relation_type", "confidence", "evidence_id")
    k = e.groupBy("node", "relation_type").count().groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), "relation_type"))), 1, kinds).alias("k"))
    k = k.select(F.col("node").alias("_n"), F.array_join(F.transform("k", lambda x: x["relation_type"]), ",").alias("kinds"))
    a = e.groupBy("node").agg(
        F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("relations"), F.count_distinct("evidence_id").alias("sources"),
        F.min(F.struct((-F.col("confidence")).alias("less"), "id"))["id"].alias("strongest"),
    )
    return a.join(k, F.col("node") == F.col("_n")).drop("_n")


def benchmark_prf(found: DataFrame, truth: DataFrame, exhaustive: tuple[str, ...]) -> DataFrame:
    """entity_type, hit, want, got, recall and, for types whose truth is exhaustive, precision and f1. found, truth: evidence_id,
    entity_type, key, each once."""
    key = ["evidence_id", "entity_type", "key"]
    f, g = found.select(*key, F.lit(1).alias("_f")).distinct(), truth.select(*key, F.lit(1).alias("_g")).distinct()
    n = f.join(g, key, "full_outer").groupBy("entity_type").agg(F.count_if(F.expr("_f = 1 AND _g = 1")).alias("hit"), F.count("_g").alias("want"), F.count("_f").alias("got"))
    whole = F.col("entity_type").isin(*exhaustive)
    return n.select(
        "*", F.round(F.col("hit") / F.col("want"), 4).alias("recall"), F.when(whole, F.round(F.col("hit") / F.col("got"), 4)).alias("precision"),
        F.when(whole, F.round(2 * F.col("hit") / (F.col("want") + F.col("got")), 4)).alias("f1"),
    )


def unreached_classes(subjects: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """subjects (present: classes in the subject's case, connected: classes it is connected to) with `unreached`: those of `classes`
    that the case holds and no relation reaches, sorted."""
    left = F.array_except(F.array_intersect("present", F.array(*map(F.lit, classes))), F.coalesce("connected", F.array().cast("array<string>")))
    return subjects.withColumn("unreached", F.array_join(F.array_sort(left), ","))


def case_snapshot(cases: DataFrame, transactions: DataFrame, entities: DataFrame, least: float = HIGH_VALUE) -> DataFrame:
    """One row a case, what a report of it starts from: case_id, case_number, window_declared, transactions, alerts (transfers of
    `least` or more), entities, first_at, last_at."""
    t = transactions.groupBy("case_id").agg(F.count("*").alias("transactions"), F.count_if(F.col("amount") >= least).alias("alerts"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
    out = cases.join(t, "case_id", "left").join(entities.groupBy("case_id").agg(F.count("*").alias("entities")), "case_id", "left")
    return out.select("case_id", "case_number", F.col("incident_start").isNotNull().alias("window_declared"), *map(_zero, ("transactions", "alerts", "entities")), "first_at", "last_at")


def claims(statements: DataFrame, links: DataFrame) -> DataFrame:
    """claim_id, sources, parties, status of statements (claim_id) by their source links (claim_id, source_id, party, stance): links
    that support and links that oppose contradict; without links a claim is unsupported."""
    per = links.groupBy("claim_id").agg(
        F.count("source_id").alias("sources"), F.count_distinct("party").alias("parties"), F.bool_or(F.col("stance") == "supports").alias("_s"), F.bool_or(F.col("stance") == "opposes").alias("_o")
    )
    out = statements.select("claim_id").join(per, "claim_id", "left")
    status = F.when(F.coalesce("sources", F.lit(0)) == 0, "unsupported").when(F.col("_s") & F.col("_o"), "contradicted").otherwise("supported")
    return out.select("claim_id", _zero("sources"), _zero("parties"), status.alias("status"))


def profile_other_cases(occurrences: DataFrame, visible: DataFrame) -> DataFrame:
    """entity_type, key, n_cases, cases of entities (case_id, entity_type, key) that several of the visible cases (case_id) hold."""
    seen = occurrences.join(visible, "case_id", "left_semi").select("case_id", "entity_type", "key").distinct()
    n = seen.groupBy("entity_type", "key").agg(F.count("*").alias("n_cases"), F.array_join(F.array_sort(F.collect_set("case_id")), ",").alias("cases"))
    return n.where("n_cases > 1")


def export_findings(reports: DataFrame, finding: str) -> DataFrame:
    """case_id, version and the fields of each finding in the JSON (column findings, an array of `finding` structures) of each case's
    latest report. reports: case_id, version, findings."""
    best = reports.groupBy("case_id").agg(F.max_by(F.struct("version", "findings"), "version").alias("b"))
    rows = F.explode(F.from_json("b.findings", f"array<{finding}>"))
    return best.select("case_id", F.col("b.version").alias("version"), rows.alias("x")).select("case_id", "version", "x.*")


def trustify_summary(evidence: DataFrame, audit: DataFrame) -> DataFrame:
    """Per case: evidence, hashes, latest, head (hash of the latest), audit, receipts, latest_receipt. evidence: case_id, evidence_id,
    sha256; audit: case_id, audit_id, is_receipt."""
    n = evidence.groupBy("case_id").agg(F.count("*").alias("evidence"), F.count("sha256").alias("hashes"), F.max("evidence_id").alias("latest"), F.max_by("sha256", "evidence_id").alias("head"))
    a = audit.groupBy("case_id").agg(F.count("*").alias("audit"), F.count_if("is_receipt").alias("receipts"), F.max(F.when(F.col("is_receipt"), F.col("audit_id"))).alias("latest_receipt"))
    return n.join(a, "case_id", "left").withColumns({c: _zero(c) for c in ("audit", "receipts")})


def case_health(records: DataFrame, most: float) -> DataFrame:
    """Per case: completed, failed, open_alerts (open records of `most` or more), untimed, contradictions (parties whose records
    disagree in status). records: case_id, sender, receiver, status (F, P or O), amount, at."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    status = F.col("status")
    against = records.groupBy("case_id", "sender", "receiver").agg(F.count_distinct("status").alias("n")).where("n > 1").groupBy("case_id").agg(F.count("*").alias("contradictions"))
    out = records.groupBy("case_id").agg(
        n(status == "F", "completed"), n(status == "P", "failed"), n((F.col("amount") >= most) & (status == "O"), "open_alerts"), n(F.col("at").isNull(), "untimed")
    )
    return out.join(against, "case_id", "left").withColumn("contradictions", _zero("contradictions"))


def evidence_stages(runs: DataFrame, key: str, stages: list[str]) -> DataFrame:
    """key, place, stage, state, attempts, current: every stage of each key in order; one without a run is pending, the last that was
    reached is current. runs: key, place, state, at, run_id."""
    n = runs.groupBy(key, "place").agg(F.count("*").alias("runs"), F.max_by("state", F.struct("at", "run_id")).alias("state"))
    per = n.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("runs", "state")))).alias("m"), F.max("place").alias("last"))
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(x).alias("stage")) for i, x in enumerate(stages))))
    at = F.try_element_at("m", F.col("x.place"))
    return per.select(key, "m", "last", rows.alias("x")).select(
        key, "x.place", "x.stage", F.coalesce(at["state"], F.lit("pending")).alias("state"), F.coalesce(at["runs"], F.lit(0).cast("long")).alias("attempts"), (F.col("x.place") == F.col("last")).alias("current")
    )


def lineage_graph(nodes: dict[str, DataFrame], edges: dict[str, DataFrame]) -> DataFrame:
    """part (node or edge), kind, id, other: nodes (id, owner) by kind, and edges (source, target) by kind of those whose ends are
    both among the nodes that they name."""
    row = lambda df, part, kind, a, b: df.select(F.lit(part).alias("part"), F.lit(kind).alias("kind"), F.col(a).cast("string").alias("id"), F.col(b).cast("string").alias("other"))
    parts = [row(df, "node", kind, "id", "owner") for kind, df in nodes.items()] + [row(df, "edge", kind, "source", "target") for kind, df in edges.items()]
    return reduce(DataFrame.unionByName, parts)
