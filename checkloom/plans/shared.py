"""Tables written to the folder that driver and executors share, which end a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a temporary one on a single machine (tests);
    on a cluster that is an error, as the others could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends there and lost executors cost nothing.

    The files are left to the owner of the folder; a lazy result may still need them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/checkloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str, label: str = "buckets", distinct: bool = True) -> DataFrame:
    """The distinct rows of `df` (all, if not `distinct`) as a table in the shared folder, in buckets by `keys`: one shuffle, and
    none of this side in any later join or aggregate by these keys. For tables that many levels of a closure meet."""
    spark = df.sparkSession
    name, n = f"checkloom_{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(n, *keys)
    rows = rows.distinct() if distinct else rows
    rows.write.format("parquet").bucketBy(n, *keys).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
