"""Session helpers: table access and the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table `name` below `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only where the setting is missing (local tests) a temporary folder is made and remembered in the session; a
    cluster without the setting is refused, as a machine-local folder would not be seen by the other machines.
    """
    there = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder shared by all executors")
        there = "file://" + tempfile.mkdtemp(prefix="symloom-")
        spark.conf.set(CHECKPOINT_CONF, there)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new path of its own in the shared folder; nothing is created yet.

    All such paths lie in one folder per session, which Hadoop deletes when the driver ends; one whose driver was
    killed is left, and may be deleted by its name at any time.
    """
    context = spark.sparkContext
    root = _SESSION_FOLDERS.get(context.applicationId)
    if root is None:
        root = f"{shared_dir(spark)}/symloom-scratch-{context.applicationId}-{uuid.uuid4().hex[:8]}"
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _SESSION_FOLDERS[context.applicationId] = root
    return f"{root}/{purpose}-{uuid.uuid4().hex}"


#: The folder of each application of this process.
_SESSION_FOLDERS: dict[str, str] = {}
