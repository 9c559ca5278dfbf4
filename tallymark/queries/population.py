from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import health, identity, population
from ..tables import DAY_MS, OBS, RESENT, observations, read, resent, sql_hash

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


SEVERITY_Z = "CASE WHEN z >= 3 THEN 'critical' WHEN z >= 2 THEN 'high' ELSE 'medium' END"


def _concentration(rule: str, group: str) -> str:
    least, z, base, slope, most = population.CONCENTRATION[rule]
    return f"""WITH {OBS},
c AS (SELECT stream_id, jurisdiction_id, {group} AS subject, count(*) AS n FROM obs GROUP BY ALL),
s AS (SELECT *, sum(n) OVER w AS total, avg(n) FILTER (subject IS NOT NULL) OVER w AS mean, stddev_pop(n) FILTER (subject IS NOT NULL) OVER w AS deviation,
  count(*) FILTER (subject IS NOT NULL) OVER w AS groups FROM c WINDOW w AS (PARTITION BY stream_id, jurisdiction_id)),
z AS (SELECT *, (n - mean) / deviation AS z FROM s WHERE subject IS NOT NULL AND groups >= 2 AND deviation > 0)
SELECT '{rule}' AS rule_id, stream_id, jurisdiction_id, subject, n, CAST(total AS BIGINT) AS total, round(mean, 4) AS mean, round(deviation, 4) AS deviation, round(z, 4) AS z_score,
  round(100.0 * n / total, 4) AS percent, round(least({most}, {base} + {slope} * z), 6) AS confidence, {SEVERITY_Z} AS severity,
  {sql_hash(f"'{rule}'", 'stream_id', 'jurisdiction_id', 'subject', 'n', 'CAST(total AS BIGINT)')} AS candidate_hash
FROM z WHERE n >= {least} AND z >= {z}"""


for _rule, _group in (("frequency_spike", "category"), ("geographic_cluster", "city"), ("repeat_entity", "entity")):
    QUERIES[_rule] = lambda spark, sf_dir, rule=_rule, group=_group: population.concentration(observations(spark, sf_dir), rule, group)
    ORACLES[_rule] = _concentration(_rule, _group)


@query(
    "trend_anomaly",
    """WITH c AS (SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY ALL),
l AS (SELECT *, lag(y) OVER w AS py, lag(n) OVER w AS pn FROM c WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority ORDER BY y)),
x AS (SELECT *, 100.0 * (n - pn) / pn AS change FROM l WHERE y - py = 1 AND pn >= 10)
SELECT o_orderstatus, o_orderpriority, y AS year, pn AS prior_count, n AS current_count, round(CAST(change AS DOUBLE), 4) AS percent_change,
  round(least(0.95, 0.55 + abs(CAST(change AS DOUBLE)) / 500), 6) AS confidence,
  CASE WHEN abs(change) >= 200 THEN 'critical' WHEN abs(change) >= 100 THEN 'high' ELSE 'medium' END AS severity
FROM x WHERE abs(change) >= 50""",
)
def trend_anomaly(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return population.trends(o, ["o_orderstatus", "o_orderpriority"], "y", "n")


@query(
    "cross_category_entity",
    f"""WITH {OBS}, x AS (SELECT jurisdiction_id, entity, count(*) AS n, list_sort(list(DISTINCT category)) AS names FROM obs GROUP BY ALL)
SELECT jurisdiction_id, entity, n, CAST(len(names) AS INT) AS categories, array_to_string(names, ',') AS names, round(least(0.93, 0.5 + 0.06 * len(names)), 6)::DOUBLE AS confidence,
  CASE WHEN len(names) >= 7 THEN 'critical' WHEN len(names) >= 5 THEN 'high' ELSE 'medium' END AS severity
FROM x WHERE n >= 10 AND len(names) >= 3""",
)
def cross_category(spark, sf_dir):
    return population.cross_category(observations(spark, sf_dir))


@query(
    "cross_jurisdiction_recurrence",
    f"""WITH {OBS}, x AS (SELECT entity, count(*) AS n, list_sort(list(DISTINCT jurisdiction_id)) AS names FROM obs GROUP BY ALL)
SELECT entity, n, CAST(len(names) AS INT) AS jurisdictions, array_to_string(names, ',') AS names, round(least(0.95, 0.5 + 0.05 * len(names) + least(n, 100) / 1000), 6)::DOUBLE AS confidence,
  CASE WHEN len(names) >= 8 THEN 'critical' WHEN len(names) >= 4 THEN 'high' ELSE 'medium' END AS severity
FROM x WHERE n >= 10 AND len(names) >= 2""",
)
def cross_jurisdiction(spark, sf_dir):
    return population.cross_jurisdiction(observations(spark, sf_dir))


@query(
    "unresolved_metadata_rate",
    f"""WITH {OBS}, u AS (SELECT entity, k AS record, bool_or(confidence IS NULL) AS unresolved, max(ts_ms) AS ts_ms FROM obs GROUP BY ALL),
x AS (SELECT entity, count(*) AS n, count(*) FILTER (unresolved) AS unresolved, max(ts_ms) AS newest_ms FROM u GROUP BY entity)
SELECT entity, n, unresolved, newest_ms, floor(unresolved / n * 1e6 + 0.5) / 1e6 AS rate,
  CASE WHEN floor(unresolved / n * 1e6 + 0.5) / 1e6 >= 0.95 AND n >= 100 THEN 'critical' WHEN floor(unresolved / n * 1e6 + 0.5) / 1e6 >= 0.8 AND n >= 10 THEN 'high' ELSE 'medium' END AS severity FROM x""",
)
def unresolved_metadata_rate(spark, sf_dir):
    obs = observations(spark, sf_dir)
    return population.rate_of_unresolved(obs.select("entity", F.col("k").alias("record"), F.col("confidence").isNull().alias("unresolved"), "ts_ms"))


@query(
    "evidence_refs",
    f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY jurisdiction_id, entity ORDER BY stream_id, "offset") AS i FROM obs)
SELECT jurisdiction_id, entity, count(*) AS refs, string_agg(stream_id || '/' || "offset", ',' ORDER BY stream_id, "offset") AS listed FROM r WHERE i <= 25 GROUP BY ALL""",
)
def evidence_refs(spark, sf_dir):
    x = population.evidence(observations(spark, sf_dir), ["jurisdiction_id", "entity"])
    return x.select("jurisdiction_id", "entity", F.size("refs").cast("long").alias("refs"), F.array_join(F.transform("refs", lambda r: F.concat_ws("/", r["stream_id"], r["offset"].cast("string"))), ",").alias("listed"))


@query(
    "candidate_limit",
    f"""WITH c AS ({_concentration('frequency_spike', 'category')}), r AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY candidate_hash) AS i, count(*) OVER (PARTITION BY stream_id) AS all_ FROM c)
SELECT stream_id, candidate_hash, all_ > 3 AS truncated FROM r WHERE i <= 3""",
)
def candidate_limit(spark, sf_dir):
    c = population.concentration(observations(spark, sf_dir), "frequency_spike", "category")
    return population.limited(c.select("stream_id", "candidate_hash"), "stream_id", "candidate_hash", 3)


@query(
    "event_identity_ledger",
    f"""WITH {RESENT} SELECT stream_id, identity_hash, min("offset") AS canonical_offset, max("offset") AS last_offset, count(*) - 1 AS replay_count, min(ingested_ms) AS first_seen_ms, max(ingested_ms) AS last_seen_ms
FROM resent GROUP BY stream_id, identity_hash""",
)
def event_identity_ledger(spark, sf_dir):
    return identity.ledger(resent(spark, sf_dir))


@query(
    "identity_ranked",
    f"""WITH {RESENT} SELECT stream_id, "offset", identity_hash, row_number() OVER (w ORDER BY "offset") AS place, count(*) OVER w AS copies, max("offset") OVER w AS last_offset
FROM resent WINDOW w AS (PARTITION BY stream_id, identity_hash)""",
)
def identity_ranked(spark, sf_dir):
    return identity.ranked(resent(spark, sf_dir))


@query(
    "canonical_observations",
    f"""WITH {RESENT} SELECT stream_id, "offset", identity_hash FROM resent QUALIFY row_number() OVER (PARTITION BY stream_id, identity_hash ORDER BY "offset") = 1""",
)
def canonical_observations(spark, sf_dir):
    return identity.canonical(resent(spark, sf_dir)).select("stream_id", "offset", "identity_hash")


_KNOWN = 'known AS (SELECT stream_id, identity_hash, min("offset") AS canonical_offset FROM resent WHERE "offset" % 2 = 0 GROUP BY ALL)'


@query(
    "replay_safe_append",
    f"""WITH {RESENT}, {_KNOWN},
new AS (SELECT stream_id, identity_hash, min("offset") AS "offset" FROM resent r WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.stream_id = r.stream_id AND k.identity_hash = r.identity_hash) GROUP BY ALL),
start AS (SELECT stream_id, max(canonical_offset) + 1 AS s FROM known GROUP BY ALL)
SELECT new.stream_id, "offset", identity_hash, row_number() OVER (PARTITION BY new.stream_id ORDER BY "offset", identity_hash) - 1 + coalesce(s, 0) AS new_offset FROM new LEFT JOIN start USING (stream_id)""",
)
def replay_safe_append(spark, sf_dir):
    rows = resent(spark, sf_dir)
    known = rows.where(F.col("offset") % 2 == 0).groupBy("stream_id", "identity_hash").agg(F.min("offset").alias("canonical_offset"))
    return identity.append_batch(rows, known)[0].select("stream_id", "offset", "identity_hash", "new_offset")


@query(
    "ingest_receipts",
    f"""WITH {RESENT}, {_KNOWN}, m AS (SELECT r.*, k.identity_hash IS NOT NULL AS seen FROM resent r LEFT JOIN known k USING (stream_id, identity_hash)),
x AS (SELECT stream_id, count(*) AS received, count(DISTINCT identity_hash) FILTER (NOT seen) AS inserted FROM m GROUP BY ALL)
SELECT stream_id, received, inserted, received - inserted AS replayed, CAST(0 AS BIGINT) AS failed, 'completed' AS status FROM x""",
)
def ingest_receipts(spark, sf_dir):
    rows = resent(spark, sf_dir)
    known = rows.where(F.col("offset") % 2 == 0).groupBy("stream_id", "identity_hash").agg(F.min("offset").alias("canonical_offset"))
    return identity.receipts(rows, *identity.append_batch(rows, known))


_AS_OF = 1_706_659_200_000  # 2024-01-31


@query(
    "stream_health",
    f"""WITH {OBS}, x AS (SELECT stream_id, count(*) AS events, min(confidence) AS lowest, max(confidence) AS highest, avg(confidence) AS average, count(*) FILTER (confidence < 0.5) AS low,
  count(*) FILTER (confidence >= 0.85) AS high, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM obs GROUP BY stream_id),
y AS (SELECT *, CASE WHEN events >= 2 THEN events / (greatest(1.0, (last_ms - first_ms) / 1000.0) / 3600) ELSE events END AS per_hour, {_AS_OF} - last_ms > {DAY_MS} AS stale FROM x),
s AS (SELECT *, CASE WHEN stale OR average IS NULL OR average < 0.35 THEN 'high' WHEN low / events > 0.4 THEN 'medium' ELSE 'info' END AS severity FROM y)
SELECT stream_id, events, round(lowest, 6) AS lowest, round(highest, 6) AS highest, round(average, 6) AS average, low, high, round(per_hour::DOUBLE, 6) AS per_hour, stale, severity,
  severity <> 'info' OR stale OR low > 0 AS alert, round(CASE WHEN average IS NULL THEN 0.5 ELSE least(greatest(1 - low / events, 0.1), 1) END, 6) AS alert_confidence FROM s""",
)
def stream_health(spark, sf_dir):
    x = health.stream_health(observations(spark, sf_dir), _AS_OF)
    r = lambda c: F.round(c, 6).alias(c)
    return x.select("stream_id", "events", r("lowest"), r("highest"), r("average"), "low", "high", r("per_hour"), "stale", "severity", "alert", r("alert_confidence"))


@query(
    "stream_runtime_summary",
    f"""WITH {RESENT} SELECT stream_id, count(*) AS events, count(confidence) AS with_confidence, count(DISTINCT identity_hash) AS identities, count(DISTINCT jurisdiction_id) AS jurisdictions,
  min("offset") AS first_offset, max("offset") AS last_offset, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM resent GROUP BY stream_id""",
)
def stream_runtime_summary(spark, sf_dir):
    return resent(spark, sf_dir).groupBy("stream_id").agg(
        F.count("*").alias("events"), F.count("confidence").alias("with_confidence"), F.count_distinct("identity_hash").alias("identities"), F.count_distinct("jurisdiction_id").alias("jurisdictions"),
        F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))


@query(
    "event_scan",
    f"""WITH {OBS} SELECT stream_id, "offset", ts_ms, entity, confidence FROM obs WHERE stream_id = (SELECT min(event_type) FROM events) AND "offset" >= 100 AND ts_ms >= 1704153600000 ORDER BY "offset" LIMIT 500""",
)
def event_scan(spark, sf_dir):
    obs = observations(spark, sf_dir)
    first = read(spark, sf_dir, "events").agg(F.min("event_type").alias("stream_id"))
    x = obs.join(F.broadcast(first), "stream_id").where("offset >= 100 and ts_ms >= 1704153600000")
    return x.select("stream_id", "offset", "ts_ms", "entity", "confidence").orderBy("offset").limit(500)


@query("keyset_page", f"""WITH {OBS} SELECT stream_id, "offset", identity_hash FROM obs WHERE (stream_id, "offset") > ('click', 200) ORDER BY stream_id, "offset" LIMIT 1000""")
def keyset_page(spark, sf_dir):
    x = observations(spark, sf_dir).where(F.struct("stream_id", "offset") > F.struct(F.lit("click"), F.lit(200).cast("long")))
    return x.select("stream_id", "offset", "identity_hash").orderBy("stream_id", "offset").limit(1000)


@query(
    "window_population",
    f"""WITH {RESENT}, l AS (SELECT stream_id, identity_hash, min("offset") AS "offset", count(*) - 1 AS replay_count FROM resent GROUP BY ALL)
SELECT stream_id, "offset", identity_hash, replay_count FROM resent JOIN l USING (stream_id, "offset", identity_hash) WHERE ts_ms BETWEEN 1704412800000 AND 1705276800000""",
)
def window_population(spark, sf_dir):
    rows = resent(spark, sf_dir)
    led = identity.ledger(rows).select("stream_id", F.col("canonical_offset").alias("offset"), "identity_hash", "replay_count")
    return rows.where(F.col("ts_ms").between(1704412800000, 1705276800000)).join(led, ["stream_id", "offset", "identity_hash"]).select("stream_id", "offset", "identity_hash", "replay_count")


@query("cursor_start", f"""WITH {OBS} SELECT stream_id, min("offset") FILTER (ts_ms >= 1705276800000) AS next_offset FROM obs GROUP BY stream_id""")
def cursor_start(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("stream_id").agg(F.min(F.when(F.col("ts_ms") >= 1705276800000, F.col("offset"))).alias("next_offset"))
