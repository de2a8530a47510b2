"""Cuts in long dataflows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in the folder of ``spark.checkpoint.dir``, which all executors share.

    A local session without the setting gets a folder of its own.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="deltadoc-")
    return f"{root.rstrip('/')}/deltadoc-{uuid.uuid4().hex}"


def measured_joins(spark: SparkSession) -> None:
    """From here on the session broadcasts a side of a join only by the size that Spark measured while it ran.

    Before a run Spark takes texts, arrays and what is made from few columns for a few bytes each, so that the
    rows of millions of documents count as small, pass through the driver and fill it. The limit stays as it was set,
    but holds for the bytes of finished shuffles; ``F.broadcast`` isn't touched.
    """
    limit, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(limit) != "-1":
        if spark.conf.get(measured, None) is None:
            spark.conf.set(measured, spark.conf.get(limit))
        spark.conf.set(limit, "-1")


def compiled_steps(spark: SparkSession) -> None:
    """From here on Spark takes the steps of a stage together only where the JVM compiles what they become.

    The JVM never compiles a method of more than 8000 bytes and walks through it instruction by instruction, while Spark
    would make methods of up to 65,535. Steps with many expressions ran several times longer than each by itself.
    """
    size = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(size)) > 8000:
        spark.conf.set(size, "8000")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and read again by all that follow.

    Several later steps use it, and without a cut each would run everything before it again. The rows go to
    the folder in ``spark.checkpoint.dir``, which all executors share; a local session without the setting
    gets a folder of its own.
    """
    measured_joins(df.sparkSession)
    compiled_steps(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="deltadoc-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
