"""Tables that are written once to the folder all machines share."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors see: `spark.checkpoint.dir`, or one of ours where unset.

    Ours is a folder of this machine, so it is made in local mode alone.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        folder = "file://" + tempfile.mkdtemp(prefix="shardfit-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are written to the shared folder once and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table of ours that no plan reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
