"""Steps of iterative operators, written to shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of local applications without the setting, which can't be changed in a running session.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder in spark.checkpoint.dir; only a local master, whose executors are the driver, may do without that."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="webloom-steps-"))
    return f"{root.rstrip('/')}/webloom-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Deletes what this application's steps have written, once all results that read it have been taken."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: no later step recomputes it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
