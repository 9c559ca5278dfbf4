"""What the operators of this subpackage share: tables, the shared folder, worker imports."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint_dir

#: ASCII white space: what separates words in every operator here.
WORD = r"[^\x20\x09-\x0D]+"
_ROOT = str(Path(__file__).resolve().parents[2])


#: the folder that driver and executors share, read from the session
shared_dir = checkpoint_dir


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder; never used again, so lazily read results stay valid."""
    return f"{shared_dir(spark).rstrip('/')}/tallymark-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there, and losing
    an executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote for frames that nothing reads any more, such as an iteration's."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def opened_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path for Python workers, and the path within it. Hadoop's names of object
    stores become Arrow's; hdfs and viewfs go through libhdfs."""
    scheme, mark, rest = uri.partition("://")
    if mark:
        uri = f"{ {'s3a': 's3', 's3n': 's3', 'wasbs': 'abfss', 'wasb': 'abfs'}.get(scheme, scheme) }://{rest}"
    elif uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def joined_widely(rows: DataFrame, dim: DataFrame, key: str, spread: Column, many: int = 4096) -> DataFrame:
    """rows with the columns of dim (unique on key, a binary column), null where dim has no such key.

    Keys that hold more than a ``many``-th of rows, of which there are fewer than ``many``, meet a
    broadcast part of dim; rows of those keys and of the null key are then dealt by ``spread`` (a hash
    of the row), so that no task of the join gets them together."""
    least = rows.count() // many
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(1, least))
    others = [c for c in dim.columns if c != key]
    near = dim.join(hot.select(key), key, "left_semi") if least else dim.limit(0)
    near = stored(near.select(F.col(key).alias("__key"), F.struct(*others).alias("__near")), "hot")
    far = dim.select(F.col(key).alias("__key"), F.struct(*others).alias("__far"))
    x = rows.join(F.broadcast(near), F.col(key) == F.col("__key"), "left").drop("__key")
    apart = F.col(key).isNull() | F.col("__near").isNotNull()
    x = x.withColumn("__at", F.when(apart, F.unhex(F.hex(spread))).otherwise(F.col(key)))
    x = x.join(far, F.col("__at") == F.col("__key"), "left").withColumn("__dim", F.when(apart, F.col("__near")).otherwise(F.col("__far")))
    return x.select(*(F.col(f"`{c}`") for c in rows.columns), *(F.col(f"__dim.`{c}`").alias(c) for c in others))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipped(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it (the same path on
    every host; clusters that install it elsewhere use --py-files)."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *known])
    return spark


def size_words(text) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)), F.lit(0)).cast("long")
