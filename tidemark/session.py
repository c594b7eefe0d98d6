"""Session settings, the shared folder, and lineage cuts used by every job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Plans are described on the driver, anew whenever they change. Tables that stand in a plan as constants would make each text megabytes long.
PLAN_CHARS = 1 << 18


def prepare(spark: SparkSession) -> SparkSession:
    """Pin UTC, bound the descriptions of plans and make sure a checkpoint folder exists.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Only a single-process master (``local``,
    ``local[n]``) may go without: it gets a fresh temporary folder. Anywhere else a missing setting is an error,
    because executors would not see each other's files.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    ctx = spark.sparkContext
    if not ctx.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", ctx.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tidemark-", dir="/tmp")
        ctx.setCheckpointDir(named)
    return spark


def settle(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet below the shared folder and go on from the written copy.

    Used where a result feeds two branches of a later plan: it keeps the work linear in the number of stages and
    lets a lost executor restart from files instead of from the raw scan. Later steps read only the columns they
    need. The folder belongs to the application and goes with its checkpoint folder.
    """
    path = scratch_dir(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder (sinks, intermediate tables and stream checkpoints of one run)."""
    prepare(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"
