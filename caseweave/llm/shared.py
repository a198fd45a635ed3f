"""Files in the folder that driver and executors share, and small helpers used by several operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Java pattern of the white space that separates words in most contracts.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset and all tasks run on this machine, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-caseweave-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df once to the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cw_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files behind a materialized frame that nothing reads any more."""
    path = getattr(df, "_cw_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores behind it as it takes to clash with none of `columns`."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _bit_split(docs: DataFrame, some: DataFrame, key: list, some_key: list[str]):
    """(rows of docs whose key is certainly not among those of `some`, the other rows with their key, the distinct keys, their
    join condition). Keys are columns or expressions; nulls equal nulls.

    A bit table of the keys of `some`, 64 bits a row and 2^20 rows at most, which bounds what is broadcast, clears most of docs
    without moving them. Where `some` is so large that most bits are set, most rows have to be shuffled: slower, and the same rows."""
    some = materialize(some.select(*some_key).distinct(), "keys")
    places = min(1 << 20, max(64, 1 << (some.count() // 4).bit_length()))
    bit, word, bits, *own = free_names([*docs.columns, *some_key], "_cw_bit", "_cw_word", "_cw_bits", *(f"_cw_key{i}" for i in range(len(key))))
    at = lambda: F.shiftrightunsigned(F.col(bit), 6).bitwiseAND(F.lit(places - 1))
    place = F.col(bit).bitwiseAND(F.lit(63)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    table_ = some.select(F.xxhash64(*some_key).alias(bit)).groupBy(at().alias(word)).agg(F.bit_or(mask).alias(bits))
    marked = docs.withColumn(bit, F.xxhash64(*key)).join(F.broadcast(materialize(table_, "bits")), at() == F.col(word), "left")
    suspect = F.coalesce(F.col(bits), F.lit(0).cast("long")).bitwiseAND(mask) != 0
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = marked.where(suspect).select(*columns, *(k.alias(o) for k, o in zip(key, own)))
    same = F.lit(True)
    for k, o in zip(some_key, own):
        same = same & keyed[o].eqNullSafe(some[k])
    return marked.where(~suspect).select(*columns), keyed, some, same


def without(docs: DataFrame, gone: DataFrame, key: list, gone_key: list[str]) -> DataFrame:
    """The rows of docs whose key is not among the rows of `gone`; see _bit_split."""
    clear, keyed, gone, same = _bit_split(docs, gone, key, gone_key)
    return clear.unionByName(keyed.join(gone, same, "left_anti").select(*clear.columns))


def within(docs: DataFrame, some: DataFrame, key: list, some_key: list[str]) -> DataFrame:
    """The rows of docs whose key is among the rows of `some`; see _bit_split."""
    clear, keyed, some, same = _bit_split(docs, some, key, some_key)
    return keyed.join(some, same, "left_semi").select(*clear.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(col):
    """Array of the words of a text column; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), SPACE), lambda w: w != "")
