"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, kind: str) -> str:
    """The path of a folder, not yet made, below spark.checkpoint.dir; a local session without the setting has one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/groundwork-checkpoints"
    return f"{base.rstrip('/')}/groundwork-{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame, kind: str = "table") -> DataFrame:
    """df, written once in the shared folder and read from there: its plan begins anew, and lost executors lose nothing of it."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, column: str, n: int, kind: str = "table") -> DataFrame:
    """settled(df) with each value of column in one of n buckets: a join by it with what is dealt alike moves no row of this table."""
    name = f"groundwork_{uuid.uuid4().hex}"
    df.write.bucketBy(n, column).option("path", new_folder(df.sparkSession, kind)).saveAsTable(name, format="parquet")
    found = df.sparkSession.table(name)
    # Buckets need a name in the catalogue to be written; the files and what was read from there stay.
    df.sparkSession.sql(f"DROP TABLE {name}")
    return found
