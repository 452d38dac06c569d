"""Written tables that end a lineage: what a fixpoint, an operator or a streaming batch hands on survives the loss of an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir.  Only where that is unset and all tasks run in this process, a temporary one, removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        folder = tempfile.mkdtemp(prefix="tidegraph-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own[context.applicationId] = "file://" + folder
    return _own[context.applicationId]


def fresh(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def put(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def counted(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """put() and the number of rows, counted by the same job."""
    seen = Observation()
    out = put(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return out, seen.get["n"]


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to a folder of its own and read back."""
    return put(df, fresh(df.sparkSession, name))


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Remove the folders of tables that cut() or put() returned, when nothing will read them again."""
    for df in tables:
        delete(df.sparkSession, df._written_at)
