"""Each kind of filter by itself, late data, and which adapters are due."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import time_bucket
from ..operators import schedule
from ..plans import filters
from ..tables import DAY_MS, OBS, epoch_ms, joined_hash, observations, read, sql_hash

QUERIES, ORACLES = {}, {}

_COLUMNS = {"source_ids": "stream_id", "source_families": "city", "signal_types": "category", "space_types": "city", "space_ids": "entity", "jurisdiction_ids": "jurisdiction_id", "entity_ids": "entities", "relationship_types": "category", "group": "jurisdiction_id"}
_T0, _T1 = 1_704_500_000_000, 1_705_500_000_000
#: filter -> (parameters, what SQL keeps)
SCOPES = {
    "source_scope": ({"source_ids": ["click", "view"], "source_families": ["city_1", "city_4"]}, "stream_id IN ('click', 'view') AND city IN ('city_1', 'city_4')"),
    "signal_type_scope": ({"signal_types": ["cat_3", "cat_9"]}, "category IN ('cat_3', 'cat_9')"),
    "jurisdiction_scope": ({"jurisdiction_ids": ["ASIA", "EUROPE"]}, "jurisdiction_id IN ('ASIA', 'EUROPE')"),
    "actor_entity_scope": ({"entity_ids": ["ent_3", "cat_5"]}, "(entity IN ('ent_3', 'cat_5') OR category IN ('ent_3', 'cat_5'))"),
    "relationship_scope": ({"relationship_types": ["cat_2"]}, "category = 'cat_2'"),
    "time_window_scope": ({"start": _T0, "end": _T1, "as_of": _T1 - DAY_MS}, f"ts_ms BETWEEN {_T0} AND {_T1 - DAY_MS}"),
    "provenance_threshold": ({"minimum_confidence": 0.4}, "confidence >= 0.4"),
    "domain_space_scope": ({"space_ids": ["ent_2", "ent_7"]}, "entity IN ('ent_2', 'ent_7')"),
}


def _scoped(spark, sf_dir, name, parameters):
    obs = observations(spark, sf_dir).withColumn("entities", F.array("entity", "category")).withColumn("fingerprint", joined_hash(F.col("category"), F.col("jurisdiction_id"), time_bucket(F.col("ts_ms"), DAY_MS)))
    known = {k: v for k, v in parameters.items() if k in filters.KINDS[name].parameters}
    return filters.resolve(requested=[{"filter_id": name, "parameters": known}]).apply(obs, _COLUMNS).select("stream_id", "offset")


for _name, (_parameters, _keep) in SCOPES.items():
    QUERIES[f"filter_{_name}"] = lambda spark, sf_dir, name=_name, parameters=_parameters: _scoped(spark, sf_dir, name, parameters)
    ORACLES[f"filter_{_name}"] = f'WITH {OBS} SELECT stream_id, "offset" FROM obs WHERE {_keep}'

_WIDE = f"""{OBS}, f AS (SELECT *, {sql_hash('category', 'jurisdiction_id', f'ts_ms // {DAY_MS}')} AS fingerprint FROM obs)"""
QUERIES["filter_deterministic_deduplication"] = lambda spark, sf_dir: _scoped(spark, sf_dir, "deterministic_deduplication", {})
ORACLES["filter_deterministic_deduplication"] = f'WITH {_WIDE} SELECT stream_id, "offset" FROM f QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY coalesce(confidence, -1) DESC, "offset") = 1'
QUERIES["filter_convergence_window"] = lambda spark, sf_dir: _scoped(spark, sf_dir, "convergence_window", {"minimum_signal_count": 60, "window_ms": DAY_MS})
ORACLES["filter_convergence_window"] = f'WITH {OBS} SELECT stream_id, "offset" FROM obs QUALIFY count(*) OVER (PARTITION BY jurisdiction_id, ts_ms // {DAY_MS}) >= 60'


def late_activity(spark, sf_dir):
    return schedule.as_of_activity(observations(spark, sf_dir).withColumn("ingested_ms", F.col("ts_ms") + (F.col("k") % 20) * DAY_MS), _T1, DAY_MS)


QUERIES["late_activity"] = late_activity
ORACLES["late_activity"] = f"WITH {OBS} SELECT stream_id, ts_ms // {DAY_MS} * {DAY_MS} AS start_ms, count(*) AS n, count(*) FILTER (ts_ms + (k % 20) * {DAY_MS} > {_T1}) AS late FROM obs WHERE ts_ms <= {_T1} GROUP BY ALL"


def due_adapters(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("adapter"), (F.col("c_custkey") % 3 * 6 + 6).alias("interval_hours"), (F.col("c_custkey") % 7 * 30).alias("delay_s"))
    r = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("adapter"), epoch_ms("o_orderdate").alias("started_ms"), F.when(F.col("o_orderstatus") != "P", epoch_ms("o_orderdate") + 60000).alias("completed_ms"))
    return schedule.due(a, r, 1_000_000_000_000, 900_000_000_000)


QUERIES["due_adapters"] = due_adapters
ORACLES["due_adapters"] = """WITH a AS (SELECT c_custkey AS adapter, c_custkey % 3 * 6 + 6 AS interval_hours, c_custkey % 7 * 30 AS delay_s FROM customer), r AS (SELECT o_custkey AS adapter, epoch_us(o_orderdate) // 1000 AS started_ms, CASE WHEN o_orderstatus <> 'P' THEN epoch_us(o_orderdate) // 1000 + 60000 END AS completed_ms FROM orders),
l AS (SELECT adapter, max(started_ms) AS last_ms, bool_or(completed_ms IS NULL) AS running FROM r WHERE started_ms <= 1000000000000 GROUP BY ALL)
SELECT adapter, last_ms, CAST(coalesce(last_ms + interval_hours * 3600000, 900000000000 + delay_s * 1000) AS BIGINT) AS next_ms, coalesce(running, false) AS running, NOT coalesce(running, false) AND coalesce(last_ms + interval_hours * 3600000, 900000000000 + delay_s * 1000) <= 1000000000000 AS due FROM a LEFT JOIN l USING (adapter)"""
