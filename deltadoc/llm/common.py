"""What the operators share: the scratch folder, written tables and tables by name."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    Only where the setting is missing (a local session) a folder of this machine is used.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="deltadoc-")
    return f"{root.rstrip('/')}/deltadoc-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread of files, never a rerun of what made them.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_join(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """``many`` with its key's row of ``one``, which has a row for each key with ``n``, how often ``many`` has it.

    Keys with more than a thousandth of the ``total`` rows, of which there are less than a thousand, are named
    by their hashes and broadcast; the others are shuffled, so no task gets more than that share under one key.
    """
    place = F.xxhash64(key)
    hot = [r[0] for r in one.where(F.col("n") > total // 1000).select(place).distinct().collect()]  # less than a thousand
    if not hot:
        return many.join(one, key)
    rest = many.where(~place.isin(hot)).join(one.where(~place.isin(hot)), key)
    return many.where(place.isin(hot)).join(F.broadcast(one.where(place.isin(hot))), key).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
