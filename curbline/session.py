"""Session settings and the place for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target

LOCAL_SETTINGS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.driver.memory": "12g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_OWN_FOLDERS: dict[str, str] = {}


def local_session(name: str = "curbline", cores: int | str = "*", shared: str | None = None) -> SparkSession:
    """A session for tests and the bench, with its folder for written tables. Jobs on a cluster bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in LOCAL_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read, as the cluster names it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:  # the setting itself cannot be changed in a running session
        _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="curbline-")
    return _OWN_FOLDERS[app]


def ship() -> None:
    """Send this package's functions to Python workers by value, so that a
    cluster's workers need not have the package installed."""
    import curbline

    if curbline.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(curbline)


def at_once(spark: SparkSession, *chains: Callable) -> list:
    """What the functions return, in their order. They run at the same time: a chain of small jobs, each waiting for
    the one before, leaves most cores to another. Job groups and other local properties hold for all."""
    with ThreadPoolExecutor(len(chains)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(c)) for c in chains]]


class Workspace:
    """Named intermediate tables, written as parquet under the shared folder.

    Writing cuts the lineage: an executor lost later costs a re-read of a
    finished table and no recomputation of earlier rounds. One workspace
    belongs to one job, so two jobs never share a path.
    """

    def __init__(self, spark: SparkSession, label: str = "job"):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/curbline/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:10]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a superseded table of this workspace."""
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name))
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(target, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
