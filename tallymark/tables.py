"""The driver's tables as the engine's abstractions, on Spark and as SQL for the oracle.

Times are epoch milliseconds (long), computed without the session's time zone; values that feed hashes
or groupings are integers and text, so that both engines agree to the last bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

US = chr(31)
DAY_MS = 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(col: str):
    """Milliseconds of a zone-less timestamp, rounded down."""
    return F.expr(f"floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({col} as timestamp_ntz)) / 1000)").cast("long")


def joined_hash(*cols):
    """SHA-256 of texts joined by U+001F; null counts as empty, so places stay apart."""
    return F.sha2(F.concat_ws(US, *(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 256)


def sql_hash(*cols: str) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols) + "))"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: stream, offset, time, jurisdiction, category, city, entity, confidence and
    the identity hash of their content."""
    e = read(spark, sf_dir, "events")
    regions = read(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("jurisdiction_id"))
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select(
        F.col("event_type").alias("stream_id"), F.col("event_id").alias("offset"), epoch_ms("ts").alias("ts_ms"), k.alias("k"), "user_id",
        (F.col("user_id") % 5).cast("int").alias("r_regionkey"),
        F.when(k % 11 == 0, F.lit(None).cast("double")).otherwise(F.least(F.col("value") / 100, F.lit(1.0))).alias("confidence"),
    )
    e = e.join(regions, "r_regionkey").select(
        "stream_id", "offset", "ts_ms", "k", "user_id", "jurisdiction_id", "confidence",
        F.concat(F.lit("cat_"), F.floor(F.sqrt("k")).cast("string")).alias("category"),
        F.when(F.col("k") % 10 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("city_"), F.floor(F.sqrt((F.col("k") * 37) % 100)).cast("string"))).alias("city"),
        F.concat(F.lit("ent_"), F.floor(F.sqrt("user_id")).cast("string")).alias("entity"),
    )
    return e.withColumn("identity_hash", joined_hash(*map(F.col, ("stream_id", "ts_ms", "jurisdiction_id", "category", "city", "entity", "k"))))


OBS = f"""obs AS (
  SELECT *, {sql_hash('stream_id', 'ts_ms', 'jurisdiction_id', 'category', 'city', 'entity', 'k')} AS identity_hash FROM (
    SELECT event_type AS stream_id, event_id AS "offset", epoch_us(ts) // 1000 AS ts_ms, k, user_id, r_name AS jurisdiction_id,
      CASE WHEN k % 11 = 0 THEN NULL ELSE least(value / 100, 1.0) END AS confidence,
      'cat_' || CAST(floor(sqrt(k)) AS INT) AS category,
      CASE WHEN k % 10 = 0 THEN NULL ELSE 'city_' || CAST(floor(sqrt((k * 37) % 100)) AS INT) END AS city,
      'ent_' || CAST(floor(sqrt(user_id)) AS INT) AS entity
    FROM (SELECT *, CAST(props->>'$.k' AS INT) AS k FROM events) e JOIN region ON r_regionkey = user_id % 5))"""


def resent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with every tenth delivered again at a later offset, to exercise replay handling."""
    obs = observations(spark, sf_dir)
    again = obs.where(F.col("offset") % 10 == 3).withColumn("offset", F.col("offset") + 1_000_000_000)
    return obs.unionByName(again).withColumn("ingested_ms", F.col("ts_ms") + F.when(F.col("offset") >= 1_000_000_000, F.lit(DAY_MS)).otherwise(F.lit(1000)))


RESENT = f"""{OBS}, resent AS (
  SELECT *, ts_ms + CASE WHEN "offset" >= 1000000000 THEN {DAY_MS} ELSE 1000 END AS ingested_ms FROM (
    SELECT * FROM obs UNION ALL SELECT * REPLACE ("offset" + 1000000000 AS "offset") FROM obs WHERE "offset" % 10 = 3))"""
