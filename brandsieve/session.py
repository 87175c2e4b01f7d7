"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediates, as the cluster names it.

    ``spark.checkpoint.dir`` is read from the session. Only a local master without that
    setting, as in tests, gets a temporary folder, the same one for the whole application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="brandsieve-")
    return _local_folders[application]


def written_once(df: DataFrame) -> DataFrame:
    """The same rows from the checkpoint folder, for narrow tables that several passes read.

    Spark removes the files with the last reference, if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table in the shared folder. The table belongs to the caller:
    it is read lazily, so only the caller knows when it may go."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete files that nobody reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
