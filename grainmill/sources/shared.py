"""The folder that all executors share: cut points and small binary files.

The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests, local mode)
does this module choose one itself.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's address, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="grainmill-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later stages start from the files, whatever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """:func:`cut`, and how many of the rows written meet ``condition``: counted on the way, without another pass."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return out, int(seen.get["n"])


def drop_cut(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`cut` that is no longer read."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    root = shared_dir(spark)
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in parent and parent.split("://")[-1].lstrip("/").startswith(root.split("://")[-1].lstrip("/")):
            p = jvm.org.apache.hadoop.fs.Path(parent)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def put_bytes(spark: SparkSession, data: bytes, suffix: str = ".bin") -> str:
    """Store ``data`` (a model of bounded size) in the shared folder and ship it to every executor, also to later ones.

    Returns the name under which ``pyspark.SparkFiles.get`` finds the local copy, fit for memory-mapping.
    """
    name = f"gm-{uuid.uuid4().hex}{suffix}"
    uri = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        step = 1 << 22
        for i in range(0, len(data), step):
            out.write(bytearray(data[i : i + step]))
    finally:
        out.close()
    spark.sparkContext.addFile(uri)
    return name
