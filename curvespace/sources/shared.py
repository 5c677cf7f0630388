"""The folder that driver and executors share, and tables written there to end a lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started from."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if REPO not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, have) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a folder is made on this machine, but only if the session runs on
    it alone; elsewhere that raises."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    got = spark.sparkContext._jsc.sc().getCheckpointDir()
    if got.isDefined():
        return got.get()
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="curvespace-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def file_system(uri: str):
    """``(file system, path)`` of a file that Spark names by ``uri``, for tasks that read parts of it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", unquote(uri))))


def keep(df: DataFrame, *by: str, options: dict[str, object] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: lineage ends here, so a lost executor
    costs a re-read and never a second, differently ordered evaluation. ``by``: long columns to lay the files out by,
    so that a filter on them reads no other files. ``options``: more options of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(options or {})).partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by :func:`keep` (without ``by``) that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
