"""Cutting lineage in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where the setting is unset and all tasks run on this machine, as in tests, a
    temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-caseweave-"))
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def shared_checkpoint(spark: SparkSession):
    """A function that writes a frame to the shared folder and reads it back. `cut(df, instead_of=old)` deletes what `old`, an
    earlier result of it, was written to, once df is there."""
    shared_folder(spark)

    def cut(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
        path = shared_path(spark, "cut")
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        out._cw_cut = path
        if (old := getattr(instead_of, "_cw_cut", None)) is not None:
            remove(spark, old)
        return out

    return cut
