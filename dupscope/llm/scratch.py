"""Tables that cut lineage: Parquet in the folder that the cluster shares.

The folder is ``spark.checkpoint.dir`` of the session.  Only where it is unset on a local
master, as in tests, one of our own is made; on a cluster it must be set.  Parquet replicated by the store survives a lost executor;
nothing here is kept in executors' memory or on their local disks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; deleted when Python exits."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="dupscope-")
            spark.conf.set("spark.checkpoint.dir", base)
        _roots[app] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"

        def clean(path: str = _roots[app]) -> None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the JVM may have gone first
                pass

        atexit.register(clean)
    return _roots[app]


def write(df: DataFrame, name: str = "t") -> str:
    """Write df as Parquet in the shared folder; its path."""
    path = f"{root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """df read back from a written table: later plans start from the files."""
    path = write(df, name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame from :func:`cut`, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{root(spark).rsplit('/', 1)[-1]}/" in path:  # a table below this application's own folder
            _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
