"""What an iterative plan needs of the session: tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where it is unset a local session takes a temporary folder; on a cluster executors would not see one, so that is an
    error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Spark's setting by which what a query has shuffled is deleted when the query ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spool(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: computed once, sized by its files.

    A checkpoint would keep the size estimated from its plan; in a loop that joins its own results those estimates
    multiply without bound, and planning takes longer than the work. What was shuffled for it goes once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spool-{uuid.uuid4().hex}"
    as_set = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, as_set)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a spooled table that nothing reads any more, as the last round's table of a loop."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/spool-" in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
