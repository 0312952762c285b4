"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Fixed value: the characters that count as white space.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(column):
    """The text without surrounding white space."""
    return F.trim(column, F.lit(WHITE))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and everything runs on this machine a temporary folder is made; on a cluster its absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "readloom-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which ``clean`` removes."""
    path = f"{shared_dir(spark)}/readloom-{label}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(clean, spark)
    _made.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    What is written is removed by ``clean``, at the latest when the driver ends.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Remove all tables that ``materialise`` wrote in this process; gives their number.  Frames that read them can't be used any more."""
    n = 0
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        while _made:
            path = jvm.org.apache.hadoop.fs.Path(_made[-1])
            n += bool(path.getFileSystem(conf).delete(path, True))
            _made.pop()
    except Exception:  # the JVM is gone, or the folder; nothing is left to be done from here
        if not sys.is_finalizing() and getattr(spark, "_jsc", None) is not None and spark._jsc.sc().isStopped() is False:
            raise
    return n
