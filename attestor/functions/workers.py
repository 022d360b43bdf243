"""Python workers find the package wherever the driver found it."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> None:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session has no such setting (tests on one machine) a folder of this machine is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="attestor-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/attestor-{uuid.uuid4().hex}/{name}"


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that deals it out by key, whatever size Spark gives it: that goes by compressed files and columns read, not by the rows made of them."""
    return df.hint("merge")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below spark.checkpoint.dir and read it again."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
