"""Where intermediate tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the context's own checkpoint folder.

    Where neither is set, a folder of our own: a temporary one if driver and executors are one process, else one beside the
    warehouse, which executors share.
    """
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if re.fullmatch(r"local(\[.*\])?", context.master):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="winnow-"))
    else:
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_winnow")
    return context._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, label: str) -> str:
    """A path below it that nothing else has."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str) -> tuple:
    """(the path, its file system) of the JVM. Local files go without the checksums that Hadoop keeps beside them: other
    programs write to sessions, too, and don't know of those."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    fs = where.getFileSystem(conf)
    if fs.getUri().getScheme() == "file":
        fs = spark._jvm.org.apache.hadoop.fs.RawLocalFileSystem()
        fs.initialize(spark._jvm.java.net.URI("file:///"), conf)
    return where, fs
