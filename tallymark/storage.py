"""Where lineage is cut: the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, as the session names it. Only on one machine may it be unset; a temporary
    folder then stands in."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = Path(tempfile.mkdtemp(prefix="tallymark-core-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder; what it was made from is not computed again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


# Settings of a session whose results hold long texts many times: a Parquet file keeps each text once in its dictionary
# (which as a rule ends at 1 MB) and measures its pages every ten rows; tasks are not merged by what they read, as they
# write far more.
_REPEATED = {
    "parquet.dictionary.page.size": 128 << 20,
    "parquet.page.size.row.check.min": 10,
    "parquet.page.size.row.check.max": 10,
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def for_repeated_texts(spark: SparkSession, column: str) -> SparkSession:
    """A session of its own with all settings of this one, which stay as they are, and those for results that hold
    long texts many times. What is read in it is also written by its settings. column: that of the texts, of which
    Parquet files then have no statistics."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in (_REPEATED | {f"parquet.column.statistics.enabled#{column}": "false"}).items():
        own.conf.set(k, v)
    return own
