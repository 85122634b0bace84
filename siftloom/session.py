"""Session settings, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once an application, whether or not they have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):  # not when the package runs from such an archive itself
        archive = os.path.join(tempfile.mkdtemp(prefix="siftloom-"), "siftloom.zip")  # the driver's, which serves it to all
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(root):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("siftloom", os.path.relpath(full, root)))
        sc.addPyFile(archive)
    _SENT.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    send_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle width, for operators that must fix the number of partitions themselves."""
    send_package(spark)
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if "SIFTLOOM_LOCAL_DIR" not in os.environ:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        os.environ["SIFTLOOM_LOCAL_DIR"] = tempfile.mkdtemp(prefix="siftloom-")
    return "file://" + os.environ["SIFTLOOM_LOCAL_DIR"]


def mounted_dir(spark: SparkSession) -> str:
    """The shared folder as a path of the file system, for files that are read and written by position."""
    folder = shared_dir(spark)
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    elif not folder.startswith("/") or not (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:").startswith("file:"):
        raise RuntimeError("filter files need a shared folder that is mounted as a file system")
    os.makedirs(folder, exist_ok=True)
    return folder


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is gone, and with it the means to reach the folder
        pass


def forget(df: DataFrame) -> None:
    """Deletes the files of a table of durable(), which nothing reads any more."""
    for folder in {os.path.dirname(x) for x in df.inputFiles()}:
        _forget(df.sparkSession, folder)


def released(spark: SparkSession) -> None:
    """Lets the shuffle files of queries that have ended go, which Spark deletes as the driver collects their plans. The first collection
    drops what refers to a plan, the second the plan."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def durable(df: DataFrame, label: str = "cut", rows: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives the loss of executors. rows: of a file at most, if any.

    The files go when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftloom-{label}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)
