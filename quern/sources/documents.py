"""Sources and sinks of JSON documents. A source gives a DataFrame with the document's text in column ``doc``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One document for each file: path, doc."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One document for each line (JSON Lines); blank lines are no documents."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("doc"))


def column(spark: SparkSession, path: str, name: str, file_format: str = "parquet") -> DataFrame:
    """Documents in a string column of a table; other columns stay."""
    return spark.read.format(file_format).load(path).withColumn("doc", F.col(name).cast("string"))


def rendered(*fields: Column | str) -> Column:
    """A row as a JSON object; NULL fields are absent."""
    return F.to_json(F.struct(*fields))


def write_verdicts(df: DataFrame, path: str, *, valid: str = "valid", mode: str = "errorifexists") -> None:
    """Parquet partitioned by verdict, so that readers of valid documents skip the rest."""
    df.write.mode(mode).partitionBy(valid).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, removed at exit; a local one only if that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"

    def remove() -> None:
        try:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the JVM may already be gone at exit
            pass

    atexit.register(remove)
    return path
