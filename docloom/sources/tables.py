"""Written intermediate tables: lineage ends at storage that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A local folder stands in where it is unset and the master is local (tests); a cluster has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def session_folder(spark: SparkSession) -> str:
    """This application's folder below the shared one; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/docloom-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS[path] = spark
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once however often it is read."""
    spark = df.sparkSession
    path = f"{session_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docloom_path = path
    return out


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells two states of a file or folder apart: its place, time, bytes and number of files."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    inside = fs.getContentSummary(jvm_path)
    return path, fs.getFileStatus(jvm_path).getModificationTime(), inside.getLength(), inside.getFileCount()


def forget(*tables: DataFrame) -> None:
    """Remove tables of ``written`` that no plan reads any more."""
    for t in tables:
        remove(t.sparkSession, t._docloom_path)


@atexit.register
def _clear() -> None:
    for path, spark in _FOLDERS.items():
        try:
            remove(spark, path)
        except Exception:  # the session is gone: the folder's owner clears it
            pass
