"""Incremental upkeep of a case's relations and alerts as its files arrive.

A batch's new records are stored in partitions of their own, the cases they touch are evaluated again from their records, and
these cases' partitions replace the old ones. Every step overwrites what it is about to write, and the batch is marked as done
last: a batch that broke off, or comes again, leaves the same tables. Batches in any cut leave the tables that one batch leaves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import moments
from ..sources import evidence, store
from . import resolve, rules, temporal

RECORDS = "evidence_id string, record_id string, source_type string, at timestamp_ntz, sender string, receiver string, amount double, amount_role string, reference string, device string, text string, batch string, case_id string"
RELATIONS = "record_id string, evidence_id string, subject string, object string, subject_node string, relation_type string, directed boolean, confidence double, at timestamp_ntz, case_id string"
ALERTS = "rule string, severity string, key string, first_batch string, review string, case_id string"
TABLES = {"records": (RECORDS, "record_id", ("case_id", "batch")), "relations": (RELATIONS, "subject_node", ("case_id",)), "alerts": (ALERTS, "key", ("case_id",))}


def records_of(units: DataFrame) -> DataFrame:
    """case_id (the folder of a file), evidence_id (its path's hash), record_id and stated fields of units. Rows with errors go."""
    f = lambda name: F.nullif(F.try_element_at("fields", F.lit(name)), F.lit(""))
    money = moments.find_amount_detail(f("amount"), declared_monetary=True)
    case_id = F.element_at(F.split("path", "/"), -2)
    rows = units.where("error IS NULL").withColumns({"_m": money, "evidence_id": F.sha2("path", 256), "case_id": case_id})
    return rows.select(
        "evidence_id", F.concat_ws(":", F.substring("evidence_id", 1, 16), "unit_key").alias("record_id"), "source_type",
        moments.find_timestamp(f("event_time"))["at"].alias("at"), f("sender").alias("sender"), f("receiver").alias("receiver"), F.col("_m.value").alias("amount"),
        F.col("_m.role").alias("amount_role"), f("transaction_reference").alias("reference"), f("device_identifier").alias("device"), "text", "case_id",
    )


def relations_of(records: DataFrame) -> DataFrame:
    """Stated relations of records."""
    found = resolve.stated_party_edges(records)
    return found.withColumn("subject_node", store.node(F.col("case_id"), F.col("subject")))


def alerts_of(records: DataFrame, relations: DataFrame) -> DataFrame:
    """case_id, rule, severity, key of the rules that rest on records and their relations."""
    money = records.where("amount IS NOT NULL").withColumn("id", F.col("record_id"))
    contacts = temporal.contacts(relations.withColumns({"id": F.col("record_id"), "status": F.lit("machine_extracted")}))
    pairs = contacts.withColumns({"left": F.least("subject", "object"), "right": F.greatest("subject", "object")})
    devices = records.where("device IS NOT NULL").select("case_id", "device", "sender", F.array().cast("array<string>").alias("phones"))
    return rules.evaluate(
        rules.high_value(money), rules.repeated_recipient(money), rules.rapid_sequence(temporal.rapid_sequence(money, ["case_id"])), rules.shared_device(devices),
        rules.pair_rule(temporal.bursts(pairs, ["case_id", "left", "right"]), "COMMUNICATION_BURST", "MEDIUM", "left", "right"),
    )


class Upkeep:
    """The tables of a root folder that driver and executors share, kept current batch by batch."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = store.BUCKETS, prefix: str | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.prefix = prefix or f"cw_{uuid.uuid4().hex[:12]}"
        for name, (schema, key, by) in TABLES.items():
            store.create(spark, self._name(name), spark.createDataFrame([], schema), f"{self.root}/{name}", key, by, buckets)

    def _name(self, table: str) -> str:
        return f"{self.prefix}_{table}"

    def table(self, name: str) -> DataFrame:
        """The rows of a table, without the marks that keep an emptied case's partition."""
        rows = self.spark.table(self._name(name))
        return rows.where(F.col(TABLES[name][1]).isNotNull())

    def _done(self) -> DataFrame | None:
        path = f"{self.root}/batches"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        return self.spark.read.schema("batch string").parquet(path) if there else None

    def apply(self, units: DataFrame, batch: str) -> bool:
        """Take in a batch of units; False if it was taken in before. Records of files that another batch has brought are left
        as they are."""
        done = self._done()
        if done is not None and done.where(F.col("batch") == batch).take(1):
            return False
        stored, alerts = self.spark.table(self._name("records")), self.spark.table(self._name("alerts"))
        new = records_of(units)
        cases = new.select("case_id").distinct()
        known = store.of_cases(stored, cases).where(F.col("batch") != batch).select("case_id", "evidence_id").distinct()
        new = new.join(known, ["case_id", "evidence_id"], "left_anti").withColumn("batch", F.lit(batch))
        store.replace(self._name("records"), new, "record_id", ("case_id", "batch"), self.buckets)
        # a batch that broke off may have stored its records already, so the cases are read from there
        self.spark.catalog.refreshTable(self._name("records"))
        changed = self.spark.table(self._name("records")).where(F.col("batch") == batch).select("case_id").distinct()
        rows = store.of_cases(self.table("records"), changed)
        found = relations_of(rows)
        store.replace(self._name("relations"), self._kept(found, changed, "relations"), "subject_node", buckets=self.buckets)
        raised = alerts_of(rows, found)
        old = store.of_cases(alerts.where("key IS NOT NULL"), changed).select("case_id", "rule", "key", "first_batch", "review")
        now = raised.join(old, ["case_id", "rule", "key"], "left").withColumn("first_batch", F.coalesce("first_batch", F.lit(batch)))
        self._swap("alerts", self._kept(now, changed, "alerts"), "key")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.root}/batches")
        return True

    def _kept(self, rows: DataFrame, changed: DataFrame, table: str) -> DataFrame:
        """rows and, for each changed case, a mark: a case without rows has its partition replaced too."""
        return rows.unionByName(changed, allowMissingColumns=True).select(*self.spark.table(self._name(table)).columns)

    def _swap(self, table: str, rows: DataFrame, key: str) -> None:
        """Replace partitions by rows that are made from them: written aside first."""
        aside = f"{self.root}/aside-{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        store.replace(self._name(table), self.spark.read.schema(rows.schema).parquet(aside), key, buckets=self.buckets)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(aside)
        where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def review(self, case_id: str, rule: str, key: str, verdict: str) -> None:
        """Note a person's verdict on an alert; it stays through later batches for as long as the alert is raised."""
        case = self.spark.table(self._name("alerts")).where(F.col("case_id") == case_id)
        mine = (F.col("rule") == rule) & (F.col("key") == key)
        self._swap("alerts", case.withColumn("review", F.when(mine, verdict).otherwise(F.col("review"))), "key")

    def take_new_files(self, path: str, checkpoint: str, units: Callable[[DataFrame], DataFrame] = evidence.of_files, **options) -> None:
        """Take in the files under `path` that are new since the last call, in batches as `options` of the stream say."""
        schema = "path string, modificationTime timestamp, length long, content binary"
        files = self.spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").options(**options).load(path)
        query = files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.apply(units(df), f"files-{n}") and None)
        query.trigger(availableNow=True).start().awaitTermination()
