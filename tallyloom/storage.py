"""Tables written between the stages of a long job.

A stage that is read more than once, or that ends a costly lineage, is written
as Parquet into the folder that all executors share (``spark.checkpoint.dir``).
Lost executors then cost only their own tasks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the session's setting, or a temporary
    one of our own where none is set and everything runs in this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = context.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
    return _LOCAL[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass


def new_path(spark: SparkSession, name: str) -> str:
    """A path of our own in the shared folder, removed when the scope ends in
    which it was asked for, or else the Python process."""
    path = f"{shared_folder(spark)}/tallyloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    else:
        atexit.register(_remove, spark, path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables between stages that are written inside are removed at the end:
    for jobs of many operators. Results must be written before it ends."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _remove(spark, path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder now and return a reader of the copy,
    which is kept as new_path says."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files so small that fewer tasks read it than there are cores,
    spread over them for costly steps by row; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
