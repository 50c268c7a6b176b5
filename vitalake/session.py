"""What a session must have; settings of a cluster are never overridden."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names, or that was set before.

    Only where none is set and all runs on one machine, as in tests, a temporary one is made, and
    removed at the end; on a cluster that names none a ValueError is raised.
    """
    sc = spark.sparkContext
    present = sc._jsc.sc().getCheckpointDir()
    if not present.isEmpty():
        return present.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="vitalake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, as a compressed table of its own in the shared folder, for what is read more than once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
