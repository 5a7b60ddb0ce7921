"""What the operators of this subpackage share: inputs, shared storage, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import ready

#: Words are runs of characters other than ASCII white space, as a Java pattern.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one only a local session has a temporary folder; on a cluster
    each executor would write to its own disk, so that is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: its lineage ends there,
    so a lost executor costs nothing that is already written."""
    spark = df.sparkSession
    path = new_path(spark, "settled")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns in this order; extra columns, whatever their names, are left out."""
    ready(df.sparkSession)
    return df.select(*[F.col(f"`{n}`") for n in names])
