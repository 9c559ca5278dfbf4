"""Registries of geographies from JSON files: one object a file, with where it comes from and its records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import registry_faults
from ..tables import joined_hash

RECORD = ("array<struct<jurisdiction_id:string,source_id:string,source_record_id:string,name:string,level:string,fips_code:string,parent_jurisdiction_id:string,"
          "area_sq_km:double,centroid_lat:double,centroid_lon:double,effective_from:string,effective_to:string,adjacent_to:array<string>>>")  # fmt: skip
SCHEMA = f"source_id string, source_version string, source_url string, jurisdiction string, records {RECORD}"


@dataclass(frozen=True)
class Geography:
    records: DataFrame  #: as in the file
    adjacency: DataFrame  #: src, dst, upper case
    runtime: DataFrame  #: node (upper case), name, level, fips, area, lat, lon
    version: str  #: digest over all fields of all records


def load(spark: SparkSession, path: str) -> Geography:
    """The registry in the files at path (a file, a folder or a pattern). Raises where a file names no source
    or holds no records, and where records are faulty."""
    files = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    if files.isEmpty() or not files.where("source_id is null or records is null or size(records) = 0").isEmpty():
        raise ValueError(f"{path}: a registry needs a source_id and records")
    records = files.select(F.col("source_version"), F.col("jurisdiction"), F.inline("records"))
    up = lambda c: F.upper(F.trim(F.col(c)))
    runtime = records.select(up("jurisdiction_id").alias("node"), "name", "level", F.col("fips_code").alias("fips"), F.col("area_sq_km").alias("area"), F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"))
    adjacency = records.select(up("jurisdiction_id").alias("src"), F.explode("adjacent_to").alias("dst")).withColumn("dst", up("dst"))
    faults = registry_faults(runtime, adjacency).union(records.where("fips_code is not null and not rlike(fips_code, '^[0-9]{2,5}$')").select(F.lit("fips_code"), "jurisdiction_id"))
    found = faults.orderBy("fault", "subject").limit(5).collect()
    if found:
        raise ValueError(f"{path}: " + "; ".join(f"{r.fault} {r.subject}" for r in found))
    fields = [c for c in records.columns if c != "adjacent_to"]
    rows = records.select(joined_hash(*(F.col(c).cast("string") for c in fields), F.array_join(F.array_sort("adjacent_to"), ",")).alias("h"))
    # a sum of digests does not depend on the order of rows
    whole = rows.agg(F.count("*").cast("string").alias("n"), *(F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}") for i in range(8)))
    version = whole.select(joined_hash(*(F.col(c) for c in whole.columns)).alias("v")).first()["v"]
    return Geography(records, adjacency, runtime, version)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """jurisdiction, source_id, source_version, records of each registry at path."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).select("jurisdiction", "source_id", "source_version", F.size("records").alias("records"))
