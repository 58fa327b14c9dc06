"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.runtime import ship

#: Rows per Arrow batch: whole texts are long, so batches are kept small.
BATCH_ROWS = "1000"


def session(spark: SparkSession) -> SparkSession:
    """The session with this package on its executors and small Arrow batches, which bound a Python worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else, in local mode alone, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_marked: set[str] = set()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; all of an application's go when it ends."""
    context = spark.sparkContext
    root = f"{shared_dir(spark)}/quillon-{context.applicationId}"
    if root not in _marked:
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        system = path.getFileSystem(context._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _marked.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage through a Parquet table in the shared folder, which survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(rows: DataFrame, table: DataFrame, key: str, by: str, salts: int = 32) -> DataFrame:
    """rows joined with ``table`` (one row a key); rows of a frequent key are spread by the hash of ``by``, so none is one task's."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    named = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(named, [key, "_salt"]).drop("_salt")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def known_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))
