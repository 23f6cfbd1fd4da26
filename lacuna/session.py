"""Sessions and the cutting of lineage."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_COUNT = itertools.count()


def get_session(app: str = "lacuna", partitions: int | None = None) -> SparkSession:
    """The active session, or a local one; a cluster's settings are never overridden."""
    builder = SparkSession.builder.appName(app)
    if SparkSession.getActiveSession() is None:
        builder = builder.config("spark.sql.session.timeZone", "UTC")
        if partitions:
            builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset, and only on a local master, a temporary folder is taken and set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    sc = spark.sparkContext
    own = sc._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lacuna-"))
        own = sc._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and checkpointed to the shared folder, so that it outlives executors and has no lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{next(_COUNT)}-{uuid.uuid4().hex[:12]}"
    atexit.register(drop_path, spark, path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path in the shared folder, if the session still lives."""
    if spark.sparkContext._jsc is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit; the folder is temporary
        pass


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: its lineage ends there. For what is large or is read
    by columns; ``cut`` keeps a partitioning and suits what is small."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
