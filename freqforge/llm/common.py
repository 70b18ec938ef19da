"""Shared by the operators: tables in the cluster's shared folder, and broadcast bounds."""
from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ship import ship

#: ASCII white space, as a Java or DuckDB character class body.
WORD = r"[^\x20\x09-\x0D]+"

_OWN_DIR: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of our own only where that is unset and Spark is one process (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        return told
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="freqforge-"))
        atexit.register(_remove_own)
    return _OWN_DIR[0]


def _remove_own() -> None:
    import shutil

    for d in _OWN_DIR:
        shutil.rmtree(d.removeprefix("file://"), ignore_errors=True)


_WRITTEN: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass


@atexit.register
def _delete_all() -> None:
    for path in list(_WRITTEN):
        _delete(path)


def table(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and any
    executor can be lost afterwards. The files go with drop() or when the session ends."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/freqforge/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._freqforge_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Remove the files of tables that nothing will read again."""
    for t in tables:
        _delete(t._freqforge_path)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]
