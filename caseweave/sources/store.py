"""Evidence tables laid out for reads by case: partitioned by case_id, bucketed by the key they are joined on.

A filter on case_id reads that case's files alone; a join to a few cases prunes at run time; joins of two tables on their
bucket keys need no exchange. A node's key holds its case (`node`), so that one column is the whole join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 8


def node(case_id: Column, key: Column) -> Column:
    """The key of an entity within its case, as one text."""
    return F.concat_ws("|", case_id.cast("string"), key)


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def create(spark: SparkSession, table: str, like: DataFrame, path: str, key: str, by: tuple[str, ...] = ("case_id",), buckets: int = BUCKETS) -> None:
    """An empty table with like's columns, partitioned by `by` and bucketed by `key`, its files under `path`. A table that is
    there already stays; files that are already under the path are found again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(where)
    names = [c for c in like.columns if c not in by]
    parted = ", ".join(f"`{c}`" for c in by)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({_columns(like.select(*names, *by))}) USING parquet PARTITIONED BY ({parted}) "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")


def replace(table: str, rows: DataFrame, key: str, by: tuple[str, ...] = ("case_id",), buckets: int = BUCKETS) -> None:
    """Put rows in place of the partitions that they name; all others stay. Writing the same rows again changes nothing.

    Rows are dealt by case and bucket first, so that a partition has a file for each of its buckets and not one for each task
    and bucket; a large case is written by as many tasks as it has buckets."""
    spark = rows.sparkSession
    order = spark.table(table).columns
    old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        bucket = F.pmod(F.hash(key), F.lit(buckets))
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.select(*order).repartition(n, *by, bucket).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)


def of_cases(table: DataFrame, cases: DataFrame) -> DataFrame:
    """The rows of some cases (case_id): partitions of other cases aren't read."""
    return table.join(cases.select("case_id").distinct(), "case_id", "left_semi")


def relation_ends(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations (with subject_node) with the display name of their subject; entities: node, display. Where both are tables
    bucketed by these columns alike, no row moves."""
    names = entities.select(F.col("node").alias("_n"), F.col("display").alias("subject_name"))
    return relations.join(names.hint("merge"), F.col("subject_node") == F.col("_n"), "left").drop("_n")
