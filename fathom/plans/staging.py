"""Cutting lineage through storage that driver and executors share.

``spark.checkpoint.dir`` names the shared folder.  Where the session has none, a session that runs in one process (tests, a laptop) uses
``/tmp/checkpoints``; on a cluster that is an error, because executors would write where others cannot read.  ``localCheckpoint`` is
never used: its blocks die with their executor.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

ONE_PROCESS = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return ONE_PROCESS


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, written in one job; the files go when the frame is collected as garbage if the session asks for that."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession, again: float = 0) -> None:
    """Shuffle files of jobs that are over go from the disks now, not when the driver happens to collect its garbage.

    Those of the last job are still held when it returns; a second time, after ``again`` seconds, finds them.
    """
    for wait in (0, again) if again else (0,):
        time.sleep(wait)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def trim_driver(spark: SparkSession) -> None:
    """Native memory that the driver's JVM has freed, but its allocator keeps, goes back to the machine (230 MB after two pipelines).

    The JVM's own command does it, HotSpot's from 17.0.9 on; others keep it.  It is called by reflection, since the class of the platform's
    server is not exported.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    kind = jvm.java.lang.Class.forName
    with contextlib.suppress(Py4JError):
        kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = kind(name)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        kind("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(server, args)


class Workspace:
    """A folder of Parquet tables under the shared folder, for intermediate results that are read more than once.

    Results may be read from it until ``drop``, or until the end of the ``scope`` that it was made in, or of the process.
    """

    _open: list[Workspace] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/fathom-{uuid.uuid4().hex}"
        self._open.append(self)

    def put(self, name: str, df: DataFrame, codec: str = "zstd") -> DataFrame:
        df.write.option("compression", codec).parquet(f"{self.root}/{name}")
        trim_driver(self.spark)
        return self.get(name, df.schema)

    def get(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        """Remove a table, or all of them; nothing may read it any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """Workspaces made inside are dropped at the end: what they hold has to be read, or written elsewhere, by then."""
    outer, Workspace._open = Workspace._open, []
    try:
        yield
    finally:
        for space in Workspace._open:
            space.drop()
        Workspace._open = outer


@atexit.register
def _drop_all() -> None:
    for space in Workspace._open:
        with contextlib.suppress(Exception):  # the session's process may be gone already
            space.drop()
