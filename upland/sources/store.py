"""Where intermediate tables are cut: a folder every executor can read."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The application's own folder below `spark.checkpoint.dir`.

    A session on one machine that hasn't set it gets a temporary folder; on a cluster, where executors couldn't read
    that, it is an error."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if base is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors can read")
            base = f"file://{tempfile.mkdtemp(prefix='upland-')}"
        _ROOTS[app] = f"{base.rstrip('/')}/upland-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except (Py4JError, AttributeError, ConnectionError, OSError):
        pass  # the session has gone; the folder is the cluster's to clear


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
