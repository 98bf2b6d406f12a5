"""What the operators share: tables, folds, and the folder that driver and executors have in common."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, so that long texts don't fill a worker: two settings of the session, only ever lowered, since
    Spark takes them from there and knows none for a single query."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = "".join(c for c in str(spark.conf.get(name, None) or "") if c.isdigit())
        if not now or int(now) <= 0 or int(now) > most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own where that is unset, in local mode only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="bitloom-")
    return _OWN[context.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/bitloom/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables and files; call it when the results that rest on them are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from the columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def column(batch, name: str):
    """A batch's column; an error where there is none."""
    at = batch.schema.get_field_index(name)
    if at < 0:
        raise ValueError(f"one column {name} is needed, among {batch.schema.names}")
    return batch.column(at)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table: cuts lineage, survives lost executors."""
    small_batches(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> None:
    """Executors collect their garbage and return what their heaps have grown by to the system, which by themselves they hardly do:
    a task a core, each a full collection of its own JVM. For the beginning of a stage that follows others."""
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()


def fold(column: str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def slots(spark: SparkSession, per_core: int = 2) -> int:
    """Partitions for a shuffle of our own: what the session asks for, at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), per_core)
