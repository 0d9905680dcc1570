"""Session helpers: tables by name, and the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, memory: str = "8g", name: str = "cairnframe") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, once per application, where their path doesn't hold it already.

    The archive is handed to Spark's own file service, which every executor fetches it from.
    """
    package = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(sc.applicationId)
    archive = Path(tempfile.mkdtemp(prefix="cairnframe-code-")) / "cairnframe.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(archive))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table `name` below `root`; nothing is read before an action."""
    ship(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts and intermediate tables, which all executors must share.

    A cluster names it in `spark.checkpoint.dir`, or the session by `setCheckpointDir`. Only on
    one machine, where neither is set (tests), a temporary folder is made and used for the life
    of the session; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root, set_ = sc.getConf().get("spark.checkpoint.dir", None), sc._jsc.sc().getCheckpointDir()
    if root is None and set_.isDefined():
        root = set_.get()
    if root is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = os.environ.get("CAIRNFRAME_SHARED") or tempfile.mkdtemp(prefix="cairnframe-")
        os.environ["CAIRNFRAME_SHARED"] = root
    if set_.isEmpty():
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more; else they stay until the driver's memory fills."""
    spark.sparkContext._jvm.System.gc()


_SCRATCH: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which `release` deletes."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def bucketed(df: DataFrame, name: str, buckets: int, key: str, sort: bool = False) -> str:
    """Writes `df` as a table bucketed by `key` in the shared folder; its name."""
    path = scratch(df.sparkSession, name)
    table_name = "cairnframe_" + path.rsplit("/", 1)[1].replace("-", "_")
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key)
    (writer.sortBy(key) if sort else writer).format("parquet").option("path", path).saveAsTable(table_name)
    return table_name


def drop(spark: SparkSession, name: str) -> None:
    """Drops a table of `bucketed` and deletes its files."""
    _delete(spark, [p for p in _SCRATCH.get(spark.sparkContext.applicationId, []) if name.endswith(p.rsplit("-", 1)[1])])


def release(spark: SparkSession) -> None:
    """Deletes every intermediate table of the session; DataFrames that read them are void afterwards."""
    _delete(spark, list(_SCRATCH.get(spark.sparkContext.applicationId, [])))


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for path in paths:
        spark.sql("drop table if exists cairnframe_" + path.rsplit("/", 1)[1].replace("-", "_"))
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        _SCRATCH[spark.sparkContext.applicationId].remove(path)


def bucket_count(df: DataFrame, rows_each: int = 1_000_000) -> int:
    """Buckets for a stored table: by its number of rows, as many as cores at least, as shuffle partitions at most."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-df.count() // rows_each)))


def few_bytes(df: DataFrame, limit: int = 8 << 20) -> bool:
    """Whether the optimizer's size estimate of `df` is at most `limit` bytes.

    Estimates of Parquet scans come from file sizes and only overestimate filters and
    aggregates, so the answer is safe to base a broadcast on.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= limit
