"""Cutting the lineage of iterative jobs on storage every executor can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def use_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
    context.setCheckpointDir(folder)


def work_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder."""
    use_checkpoint_dir(spark)
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{folder}/work-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once as a columnar table and read back.

    For results that several later jobs read: each of them then reads only
    the columns it needs, and a lost executor costs no recomputation. The
    shuffle files of the job that wrote it are given up: Spark drops them when
    the driver collects its garbage, which it may not do for hours otherwise.
    """
    spark = df.sparkSession
    path = work_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def unstage(staged: DataFrame) -> None:
    """Delete a table of ``stage`` that nothing will read again."""
    context = staged.sparkSession.sparkContext
    for file in staged.inputFiles()[:1]:
        folder = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(file)).getParent()
        if folder.getName().startswith("work-"):
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame) -> DataFrame:
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
