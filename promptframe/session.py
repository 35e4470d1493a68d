"""Session settings the library relies on, and its shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import promptframe


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options whose defaults would change results."""
    # groups may define the same variable: the later one wins
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    # an answer may repeat a JSON key: the last one wins
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # files may come in any encoding Java knows, such as windows-1252
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    # one prompt may serve a third of all combinations: split such join partitions even
    # where that costs another shuffle
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    # rows of long texts go to Python workers by bytes: there a batch is held several times
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    # Python workers need not have the package installed
    cloudpickle.register_pickle_by_value(promptframe)
    return spark


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="promptframe-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under the cluster's ``spark.checkpoint.dir``.

    A local session without that setting (tests) gets a temporary folder; a
    real cluster must name one, since executors do not share a local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        base = _local_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def widen(df: DataFrame) -> DataFrame:
    """Spread a small input over all cores before costly work per row.

    An input that already has that many partitions is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on the file system that serves it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def glob_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern with ``*``, by one call of the driver; none when there are none."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    if found is None:
        return []
    joined = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", [s.getPath() for s in found])
    return joined.split("\n") if joined else []
