"""Tables as sources: Parquet folders, JDBC, event files; intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table of a database, read in ranges of an integer key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    return reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, it is
    a folder of the warehouse; of a local session, as in tests, a temporary
    folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        folder = tempfile.mkdtemp(prefix="prospectrum-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back, so that
    later steps start from files that survive the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def event_files(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    """Callback bodies as a stream of JSON lines, files in arrival order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(folder)
