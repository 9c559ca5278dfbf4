from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convergence as conv
from ..operators import entities as ent
from ..operators import integrity
from ..tables import DAY_MS, OBS, epoch_ms, observations, read, sql_hash

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- integrity over projections of the driver tables ---


def transfers(spark, sf_dir):
    """Orders as transfers between customers."""
    n = read(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    o = read(spark, sf_dir, "orders").crossJoin(F.broadcast(n))
    return o.select(F.col("o_orderkey").alias("transfer_id"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("from_id"), F.concat(F.lit("c:"), ((F.col("o_orderkey") * 7) % F.col("n")).cast("string")).alias("to_id"), F.col("o_totalprice").alias("amount"), epoch_ms("o_orderdate").alias("ts_ms"))


TRANSFERS = """transfers AS (SELECT o_orderkey AS transfer_id, 'c:' || o_custkey AS from_id, 'c:' || ((o_orderkey * 7) % (SELECT count(*) FROM customer)) AS to_id, o_totalprice AS amount, epoch_us(o_orderdate) // 1000 AS ts_ms FROM orders)"""


@query(
    "financial_conduit",
    f"""WITH {TRANSFERS} SELECT i.to_id AS party, i.transfer_id AS in_id, o.transfer_id AS out_id, i.from_id AS origin, o.to_id AS target, (o.ts_ms - i.ts_ms) // {DAY_MS} AS gap_days, round(o.amount / i.amount, 6) AS ratio, 'high' AS severity
FROM transfers i JOIN transfers o ON i.to_id = o.from_id AND i.transfer_id <> o.transfer_id AND i.from_id <> o.to_id AND o.ts_ms >= i.ts_ms AND (o.ts_ms - i.ts_ms) // {DAY_MS} <= 30 AND o.amount / i.amount BETWEEN 0.8 AND 1.05""",
)
def financial_conduit(spark, sf_dir):
    return integrity.conduits(transfers(spark, sf_dir))


@query(
    "exact_identifier_reuse",
    """WITH i AS (SELECT 'address' AS kind, c_nationkey || '/' || c_mktsegment || '/' || CAST(floor(c_acctbal / 100) AS BIGINT) AS value, 'c:' || c_custkey AS entity_id FROM customer)
SELECT kind, value, count(*) AS entities, min(entity_id) AS first_entity, 'medium' AS severity FROM i GROUP BY kind, value HAVING count(*) >= 2""",
)
def exact_identifier_reuse(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    value = F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 100).cast("string"))
    return integrity.identifier_reuse(c.select(F.lit("address").alias("kind"), value.alias("value"), F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("entity_id")))


_P_ENT = f"""e AS (SELECT 'c:' || c_custkey AS entity_id, CASE WHEN c_custkey % 3 = 0 THEN 'Dissolved' ELSE 'active' END AS status, 1500000000000 + (c_custkey % 400) * {DAY_MS} AS formed_ms,
  CASE WHEN c_custkey % 3 = 0 THEN 1500000000000 + (c_custkey % 90) * {DAY_MS} END AS ended_ms, c_nationkey, c_mktsegment, c_custkey, c_acctbal FROM customer),
i AS (SELECT entity_id, 'agent' AS kind, c_nationkey || '/' || c_mktsegment AS value FROM e UNION ALL SELECT entity_id, 'address', CAST(CAST(floor(c_acctbal / 50) AS BIGINT) AS VARCHAR) FROM e UNION ALL SELECT entity_id, 'phone', CAST(c_custkey % 211 AS VARCHAR) FROM e)"""


@query(
    "phoenix_continuity",
    f"""WITH {_P_ENT}, p AS (SELECT a.entity_id AS predecessor, b.entity_id AS successor, (b.formed_ms - a.ended_ms) // {DAY_MS} AS gap_days, count(*) AS shared
  FROM e a JOIN i x ON x.entity_id = a.entity_id JOIN i y ON y.kind = x.kind AND y.value = x.value JOIN e b ON b.entity_id = y.entity_id
  WHERE a.ended_ms IS NOT NULL AND a.status = 'Dissolved' AND a.entity_id <> b.entity_id AND b.formed_ms >= a.ended_ms AND (b.formed_ms - a.ended_ms) // {DAY_MS} <= 730 GROUP BY ALL HAVING count(*) >= 2)
SELECT predecessor, successor, gap_days, shared, CASE WHEN gap_days <= 365 THEN 1.0 ELSE 0.85 END::DOUBLE AS confidence, 'high' AS severity FROM p""",
)
def phoenix_continuity(spark, sf_dir):
    c = read(spark, sf_dir, "customer").withColumn("entity_id", F.concat(F.lit("c:"), F.col("c_custkey").cast("string")))
    key = F.col("c_custkey")
    start = F.lit(1500000000000)
    e = c.select("entity_id", F.when(key % 3 == 0, "Dissolved").otherwise("active").alias("status"), (start + (key % 400) * DAY_MS).alias("formed_ms"), F.when(key % 3 == 0, start + (key % 90) * DAY_MS).alias("ended_ms"))
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    ids = c.select("entity_id", F.inline(F.array(one("agent", F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment")), one("address", F.floor(F.col("c_acctbal") / 50).cast("string")), one("phone", (key % 211).cast("string")))))
    return integrity.phoenix(e, ids)


@query(
    "legislative_financial_convergence",
    f"""WITH {TRANSFERS}, t AS (SELECT *, ['tag' || (transfer_id % 7), 'tag' || (transfer_id % 11)] AS tags FROM transfers),
a AS (SELECT l_orderkey * 10 + l_linenumber AS action_id, 'c:' || (l_suppkey * 7) AS actor_id, epoch_us(l_shipdate) // 1000 AS ts_ms, ['tag' || (l_partkey % 13)] AS tags FROM lineitem)
SELECT a.actor_id, transfer_id, action_id, abs(t.ts_ms - a.ts_ms) // {DAY_MS} AS gap_days, array_to_string(list_sort(list_intersect(t.tags, a.tags)), ',') AS tags, 'high' AS severity
FROM t JOIN a ON t.to_id = a.actor_id AND abs(t.ts_ms - a.ts_ms) <= {365 * DAY_MS} AND len(list_intersect(t.tags, a.tags)) > 0""",
)
def legislative_financial_convergence(spark, sf_dir):
    tag = lambda c: F.concat(F.lit("tag"), c.cast("string"))
    t = transfers(spark, sf_dir).withColumn("tags", F.array(tag(F.col("transfer_id") % 7), tag(F.col("transfer_id") % 11)))
    a = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("action_id"), F.concat(F.lit("c:"), (F.col("l_suppkey") * 7).cast("string")).alias("actor_id"), epoch_ms("l_shipdate").alias("ts_ms"), F.array(tag(F.col("l_partkey") % 13)).alias("tags"))
    return integrity.legislative_overlap(t, a)


@query(
    "source_contradiction",
    """SELECT p_brand AS subject, p_type AS predicate, count(*) AS n, count(DISTINCT p_size) AS n_values, count(DISTINCT p_size % 3) AS n_sources, 'medium' AS severity FROM part
GROUP BY ALL HAVING count(DISTINCT p_size) >= 2 AND count(DISTINCT p_size % 3) >= 2""",
)
def source_contradiction(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return integrity.contradictions(p.select(F.col("p_brand").alias("subject"), F.col("p_type").alias("predicate"), F.col("p_size").alias("value"), (F.col("p_size") % 3).alias("source")))


@query(
    "numeric_range_anomaly",
    """SELECT l_orderkey, l_linenumber, 'quantity' AS metric, l_quantity AS actual, 'above' AS side FROM lineitem WHERE l_quantity > 48
UNION ALL SELECT l_orderkey, l_linenumber, 'discount', l_discount + 0.0, 'below' FROM lineitem WHERE l_discount < 0.01""",
)
def numeric_range_anomaly(spark, sf_dir):
    none = F.lit(None).cast("double")
    one = lambda name, v, lo, hi: F.struct(F.lit(name).alias("metric"), v.alias("actual"), lo.alias("least"), hi.alias("most"))
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.inline(F.array(one("quantity", F.col("l_quantity"), none, F.lit(48.0)), one("discount", F.col("l_discount") + 0.0, F.lit(0.01), none))))
    return integrity.out_of_range(x).select("l_orderkey", "l_linenumber", "metric", "actual", "side")


@query(
    "integrity_readiness",
    f"""WITH {OBS}, x AS (SELECT count(*) AS events, count(*) FILTER (k % 6 = 0) AS entity_registration, count(*) FILTER (k % 6 = 1) AS financial_transfer, count(*) FILTER (k % 6 = 2) AS legislative_action,
  count(*) FILTER (k % 6 = 3) AS source_assertion, CAST(0 AS BIGINT) AS numeric_observation FROM obs) SELECT *, 'no_numeric_observation' AS gaps FROM x""",
)
def integrity_readiness(spark, sf_dir):
    kinds = ("entity_registration", "financial_transfer", "legislative_action", "source_assertion")
    kind = F.element_at(F.array(*map(F.lit, kinds), F.lit("other"), F.lit("other")), (F.col("k") % 6 + 1).cast("int"))
    return integrity.readiness(observations(spark, sf_dir).select(kind.alias("kind")))


# --- convergence ---

_AS_OF, _WINDOW = 1_706_659_200_000, 31 * DAY_MS
_SIGNALS = f"""{OBS}, sig AS (SELECT "offset" AS id, jurisdiction_id AS geography, category AS signal_type, ts_ms, confidence, {sql_hash('category', 'jurisdiction_id', f'ts_ms // {DAY_MS}')} AS fingerprint FROM obs)"""


def signals(spark, sf_dir):
    s = observations(spark, sf_dir).select(F.col("offset").alias("id"), F.col("jurisdiction_id").alias("geography"), F.col("category").alias("signal_type"), "ts_ms", "confidence")
    return conv.fingerprinted(s, DAY_MS)


_DEDUP = "dedup AS (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY coalesce(confidence, -1) DESC, id) = 1)"


@query("deduplicated_signals", f"WITH {_SIGNALS}, {_DEDUP} SELECT id, geography, signal_type, fingerprint, round(confidence, 9) AS confidence FROM dedup")
def deduplicated_signals(spark, sf_dir):
    return conv.deduplicated(signals(spark, sf_dir)).select("id", "geography", "signal_type", "fingerprint", F.round("confidence", 9).alias("confidence"))


_R = lambda x: f"round({x}, 9)"


@query(
    "convergence",
    f"""WITH {_SIGNALS}, {_DEDUP}, reg AS (SELECT r_name AS geography, 1000.0 + 137 * r_regionkey AS area FROM region UNION ALL SELECT 'NOWHERE', 500.0),
t AS (SELECT geography, signal_type, count(*) AS n FROM sig GROUP BY ALL),
raw AS (SELECT geography, CAST(sum(n) AS BIGINT) AS raw_count, count(*) AS distinct_types, min_by(signal_type, (-n, signal_type)) AS dominant_type FROM t GROUP BY ALL),
d AS (SELECT geography, count(*) AS signal_count, avg(confidence) AS c, max(ts_ms) AS newest FROM dedup GROUP BY ALL),
x AS (SELECT reg.geography, area, coalesce(raw_count, 0) AS raw_count, coalesce(signal_count, 0) AS n, coalesce(distinct_types, 0) AS distinct_types, dominant_type, c,
  coalesce(least(greatest(1 - ({_AS_OF} - newest) / {float(_WINDOW)}, 0), 1), 0) AS r, (SELECT sum(signal_count) FROM d) / (SELECT sum(area) FROM reg) * area AS e FROM reg LEFT JOIN raw USING (geography) LEFT JOIN d USING (geography))
SELECT geography, CASE WHEN n < 2 THEN 'below_threshold' ELSE 'resolved' END AS status, raw_count, n AS signal_count, distinct_types, dominant_type, {_R('c')} AS mean_confidence, {_R('r::DOUBLE')} AS recency,
  {_R('distinct_types * c * ln(n + 1) * (0.5 + 0.5 * r)')} AS score, {_R('e::DOUBLE')} AS expected, CASE WHEN n >= 2 THEN {_R('(n - e) / sqrt(e)')} END AS z_score, coalesce(n >= 2 AND (n - e) / sqrt(e) >= 1.0, false) AS detected FROM x""",
)
def convergence_query(spark, sf_dir):
    reg = read(spark, sf_dir, "region").select(F.col("r_name").alias("geography"), (F.lit(1000.0) + 137 * F.col("r_regionkey")).alias("area"))
    reg = reg.union(spark.range(1).select(F.lit("NOWHERE"), F.lit(500.0)))
    s = conv.window_errors(signals(spark, sf_dir), _AS_OF, _WINDOW).where("error is null").drop("error")
    x = conv.convergence(s, reg, _AS_OF, _WINDOW, threshold=1.0)
    rounded = ("mean_confidence", "recency", "score", "expected", "z_score")
    return x.select(*(F.round(c, 9).alias(c) if c in rounded else c for c in x.columns))


@query(
    "geography_resolution",
    f"""WITH reg AS (SELECT n_nationkey AS place, 'US_' || substr(n_name, 1, 2) AS geography, n_name AS name, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS fips FROM nation),
k AS (SELECT place, geography, unnest([upper(geography), upper(name), fips, substr(geography, 4)]) AS key FROM reg), l AS (SELECT key, min_by(geography, (place, geography)) AS geography FROM k GROUP BY key),
v AS (SELECT DISTINCT n_name AS value FROM nation UNION SELECT DISTINCT lower(substr(n_name, 1, 2)) FROM nation UNION SELECT '00003' UNION SELECT 'nowhere at all')
SELECT value, geography FROM v LEFT JOIN l ON l.key = upper(trim(value))""",
)
def geography_resolution(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    reg = n.select(F.col("n_nationkey").alias("place"), F.concat(F.lit("US_"), F.substring("n_name", 1, 2)).alias("geography"), F.col("n_name").alias("name"), F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("fips"))
    values = n.select(F.col("n_name").alias("value")).union(n.select(F.lower(F.substring("n_name", 1, 2)))).union(spark.range(1).select(F.lit("00003"))).union(spark.range(1).select(F.lit("nowhere at all"))).distinct()
    return conv.resolve_geography(values, reg)


# --- entities ---

_ENT = """ent AS (SELECT 's:' || s_suppkey AS entity_id, CASE WHEN s_suppkey % 4 = 0 THEN 'government_agency' ELSE 'company' END AS entity_type, s_name AS name, ['Supplier No ' || s_suppkey] AS variants,
  CAST(100000000 + s_suppkey AS VARCHAR) AS ein, s_suppkey % 10 <> 9 AS active FROM supplier),
nm AS (SELECT entity_id, regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') AS key, 1 AS tier FROM ent WHERE active UNION ALL SELECT entity_id, regexp_replace(upper(variants[1]), '[^A-Z0-9]', '', 'g'), 2 FROM ent WHERE active
  UNION ALL SELECT entity_id, 'ALIAS' || (CAST(substr(entity_id, 3) AS BIGINT) % 40), 3 FROM ent WHERE active),
names AS (SELECT key, entity_id, min(tier) AS tier FROM nm GROUP BY ALL),
cand AS (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, CASE WHEN l_linenumber % 2 = 0 THEN 'organization' ELSE 'company' END AS expected_type,
  CASE l_linenumber WHEN 1 THEN 'Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') WHEN 2 THEN 'supplier no ' || l_suppkey WHEN 3 THEN 'Alias ' || (l_suppkey % 40) WHEN 4 THEN 'nobody' WHEN 5 THEN NULL ELSE 'supplier no ' || (l_suppkey + 1) END AS name,
  CASE WHEN l_linenumber >= 5 THEN 'ein' END AS id_kind, CASE WHEN l_linenumber >= 5 THEN CAST(100000000 + l_suppkey AS VARCHAR) END AS id_value, l_orderkey, l_linenumber, row_number() OVER () AS rid FROM lineitem)"""


def _entities(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    e = s.select(F.concat(F.lit("s:"), key.cast("string")).alias("entity_id"), F.when(key % 4 == 0, "government_agency").otherwise("company").alias("entity_type"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("Supplier No "), key.cast("string"))).alias("variants"), F.create_map(F.lit("ein"), (F.lit(100000000) + key).cast("string")).alias("ids"), (key % 10 != 9).alias("active"), key.alias("_k"))
    a = e.select("entity_id", F.concat(F.lit("Alias "), (F.col("_k") % 40).cast("string")).alias("alias"), F.when(F.col("_k") % 2 == 0, "acronym").otherwise("spelling_variant").alias("alias_type"), F.lit(1.0).alias("confidence"))
    return e.drop("_k"), a


def _candidates(spark, sf_dir):
    li, n, s = read(spark, sf_dir, "lineitem"), F.col("l_linenumber"), F.col("l_suppkey")
    name = F.when(n == 1, F.concat(F.lit("Supplier#"), F.lpad(s.cast("string"), 9, "0"))).when(n == 2, F.concat(F.lit("supplier no "), s.cast("string"))).when(n == 3, F.concat(F.lit("Alias "), (s % 40).cast("string"))).when(n == 4, "nobody").when(n == 5, F.lit(None).cast("string")).otherwise(F.concat(F.lit("supplier no "), (s + 1).cast("string")))
    return li.select((F.col("l_orderkey") * 10 + n).alias("candidate_id"), F.when(n % 2 == 0, "organization").otherwise("company").alias("expected_type"), name.alias("name"), F.when(n >= 5, "ein").alias("id_kind"), F.when(n >= 5, (F.lit(100000000) + s).cast("string")).alias("id_value"))


_RESOLVED = f"""{_ENT}, bi AS (SELECT rid, count(DISTINCT entity_id) AS n_id, min(entity_id) AS id_entity FROM cand JOIN ent ON id_kind = 'ein' AND id_value = ein AND active GROUP BY ALL),
bn AS (SELECT rid, count(DISTINCT entity_id) AS n_name, min(entity_id) AS name_entity, max(entity_id) AS name_last, min(tier) AS tier FROM cand JOIN names ON regexp_replace(upper(name), '[^A-Z0-9]', '', 'g') = key GROUP BY ALL),
j AS (SELECT c.*, coalesce(n_id, 0) AS n_id, id_entity, coalesce(n_name, 0) AS n_name, name_entity, name_last, tier FROM cand c LEFT JOIN bi USING (rid) LEFT JOIN bn USING (rid)),
m AS (SELECT *, CASE WHEN n_id = 1 AND n_name > 0 AND (name_entity <> id_entity OR name_last <> id_entity) THEN 'identifier_name_conflict' WHEN n_id = 1 THEN 'exact_external_identifier' WHEN n_id > 1 THEN 'duplicate_external_identifier'
  WHEN n_name = 1 THEN ['exact_primary_name', 'exact_name_variant', 'exact_alias'][tier] WHEN n_name > 1 THEN 'duplicate_exact_name' WHEN name IS NULL AND id_kind IS NULL THEN 'no_usable_identity_value' ELSE 'no_exact_match' END AS method FROM j),
f AS (SELECT m.*, CASE WHEN starts_with(method, 'exact_') THEN CASE WHEN n_id = 1 THEN id_entity ELSE name_entity END END AS found FROM m),
g AS (SELECT f.*, found IS NOT NULL AND NOT (e.entity_type = expected_type OR expected_type = 'organization') AS wrong FROM f LEFT JOIN ent e ON e.entity_id = found),
resolved AS (SELECT candidate_id, l_orderkey, l_linenumber, CASE WHEN wrong THEN 'exact_match_entity_type_mismatch' ELSE method END AS method, CASE WHEN NOT wrong THEN found END AS entity_id, greatest(n_id, n_name) AS matches FROM g)"""


@query(
    "entity_resolution",
    f"""WITH {_RESOLVED} SELECT candidate_id, CASE WHEN entity_id IS NOT NULL THEN 'resolved' WHEN method IN ('identifier_name_conflict', 'duplicate_external_identifier', 'duplicate_exact_name') THEN 'ambiguous' ELSE 'unresolved' END AS status, method, entity_id, matches FROM resolved""",
)
def entity_resolution(spark, sf_dir):
    return ent.resolve(_candidates(spark, sf_dir), *_entities(spark, sf_dir)).select("candidate_id", "status", "method", "entity_id", "matches")


def _resolved(spark, sf_dir):
    return ent.resolve(_candidates(spark, sf_dir), *_entities(spark, sf_dir)).select("*", F.concat(F.lit("line"), (F.col("candidate_id") % 10).cast("string")).alias("stream_id"), F.floor(F.col("candidate_id") / 10).alias("offset"), F.col("candidate_id").alias("ts_ms"))


@query(
    "cross_stream_entities",
    f"""WITH {_RESOLVED}, x AS (SELECT entity_id, count(DISTINCT (l_linenumber, l_orderkey)) AS events, list_sort(list(DISTINCT 'line' || l_linenumber)) AS names, min(candidate_id) AS first_ms, max(candidate_id) AS last_ms FROM resolved WHERE entity_id IS NOT NULL GROUP BY ALL)
SELECT entity_id, events, array_to_string(names, ',') AS names, first_ms, last_ms, CAST(len(names) AS INT) AS streams FROM x WHERE len(names) >= 2""",
)
def cross_stream_entities(spark, sf_dir):
    return ent.cross_stream(_resolved(spark, sf_dir))


@query("resolution_coverage", f"""WITH {_RESOLVED} SELECT 'line' || l_linenumber AS stream_id, CASE WHEN entity_id IS NOT NULL THEN 'resolved' WHEN method IN ('identifier_name_conflict', 'duplicate_external_identifier', 'duplicate_exact_name') THEN 'ambiguous' ELSE 'unresolved' END AS status, method, count(*) AS n FROM resolved GROUP BY ALL""")
def resolution_coverage(spark, sf_dir):
    return ent.coverage(_resolved(spark, sf_dir))


@query("entity_timeline", f"""WITH {_RESOLVED} SELECT candidate_id, method FROM resolved WHERE entity_id = 's:3' AND candidate_id < 100000 ORDER BY candidate_id DESC LIMIT 50""")
def entity_timeline(spark, sf_dir):
    return ent.timeline(_resolved(spark, sf_dir), "s:3", 100_000, 50).select("candidate_id", "method")
