from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intake
from ..operators.health import run_outcome
from ..tables import OBS, observations, read, sql_hash

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _events(spark, sf_dir):
    """Observations as delivered JSON: fields are where different sources put them."""
    k = F.col("k")
    payload = F.struct(F.when(k % 3 == 0, F.col("category")).alias("issue"), F.when(k % 3 == 1, F.concat(F.lit(" "), F.col("category"), F.lit("  x "))).alias("product"), F.when(k % 2 == 0, F.col("entity")).alias("company"), F.struct(F.col("entity").alias("name")).alias("raw"))
    place = F.struct(F.when(k % 5 != 0, F.col("jurisdiction_id")).alias("state"), F.col("city").alias("county"))
    return observations(spark, sf_dir).select("stream_id", "offset", F.to_json(F.struct(F.when(k % 7 != 0, F.col("stream_id")).alias("signal_type"), payload.alias("payload"), place.alias("spacetime"))).alias("event"))


@query(
    "described_events",
    f"""WITH {OBS} SELECT stream_id, "offset", CASE k % 3 WHEN 0 THEN category WHEN 1 THEN category || ' x' ELSE CASE WHEN k % 7 <> 0 THEN stream_id ELSE 'unclassified' END END AS category, CASE WHEN k % 5 <> 0 THEN jurisdiction_id ELSE 'unknown' END AS jurisdiction, city AS geography, entity FROM obs""",
)
def described_events(spark, sf_dir):
    return intake.described(_events(spark, sf_dir)).drop("event")


@query(
    "signal_transform",
    f"""WITH {OBS}, e AS (SELECT *, CASE WHEN k % 13 = 0 THEN '' ELSE category END AS st, k % 17 = 0 AS bad_time, CASE WHEN k % 6 = 0 THEN 'elsewhere' WHEN k % 6 = 1 THEN 'STATE' ELSE lower(jurisdiction_id) END AS place, CASE WHEN k % 19 = 0 THEN 'high' WHEN k % 19 = 1 THEN '1.5' WHEN k % 19 = 2 THEN NULL ELSE '0.5' END AS c FROM obs)
SELECT stream_id, "offset", CASE WHEN st = '' THEN 'missing_signal_type' WHEN bad_time THEN 'invalid_timestamp' WHEN place = 'elsewhere' THEN 'unresolved_geography' WHEN place = 'STATE' THEN 'geography_level_mismatch' WHEN c IN ('high', '1.5') THEN 'invalid_confidence' END AS reason,
  CASE WHEN place = 'STATE' THEN 'WHOLE' WHEN place <> 'elsewhere' THEN jurisdiction_id END AS geography, CASE WHEN c = '0.5' THEN 0.5::DOUBLE END AS confidence FROM e""",
)
def signal_transform(spark, sf_dir):
    k = F.col("k")
    obs = observations(spark, sf_dir).select(
        "stream_id", "offset", F.when(k % 13 == 0, "").otherwise(F.col("category")).alias("signal_type"), F.when(k % 17 == 0, "some day").otherwise("2024-01-05T00:00:00Z").alias("timestamp"), "identity_hash",
        F.when(k % 6 == 0, "elsewhere").when(k % 6 == 1, "STATE").otherwise(F.lower("jurisdiction_id")).alias("place"), F.when(k % 19 == 0, "high").when(k % 19 == 1, "1.5").when(k % 19 == 2, F.lit(None).cast("string")).otherwise("0.5").alias("confidence"))
    reg = read(spark, sf_dir, "region").select(F.col("r_name").alias("key"), F.col("r_name").alias("geography"), F.lit("county").alias("level"))
    reg = reg.union(spark.range(1).select(F.lit("STATE"), F.lit("WHOLE"), F.lit("state")))
    return intake.to_signals(obs, reg, "county").select("stream_id", "offset", "reason", "geography", "confidence")


@query(
    "canonical_domains",
    """SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'chosen' WHEN p_partkey % 5 = 0 THEN 'labor' WHEN p_partkey % 5 = 1 THEN 'regulatory' WHEN p_partkey % 3 = 0 THEN 'housing' WHEN p_partkey % 3 = 1 THEN 'judicial' ELSE 'civic' END AS domain FROM part""",
)
def canonical_domains(spark, sf_dir):
    k = F.col("p_partkey")
    adapter = F.when(k % 5 == 0, "B-L_S").when(k % 5 == 1, "Regulations.Gov").otherwise("unheard_of")
    words = F.when(k % 3 == 0, "Tenant_Notice").when(k % 3 == 1, "lawsuit filed").otherwise("something")
    return read(spark, sf_dir, "part").select("p_partkey", intake.canonical_domain(words, adapter, F.when(k % 11 == 0, "chosen")).alias("domain"))


@query(
    "rule_registry_upsert",
    """WITH o AS (SELECT s_suppkey AS rule_id, s_name AS title, s_acctbal AS threshold FROM supplier WHERE s_suppkey % 2 = 0), n AS (SELECT s_suppkey AS rule_id, CASE WHEN s_suppkey % 5 <> 0 THEN 'new ' || s_name END AS title, CAST(s_suppkey AS DOUBLE) AS threshold FROM supplier WHERE s_suppkey % 3 = 0)
SELECT rule_id, coalesce(n.title, o.title) AS title, coalesce(n.threshold, o.threshold) AS threshold FROM o FULL JOIN n USING (rule_id)""",
)
def rule_registry_upsert(spark, sf_dir):
    s, k = read(spark, sf_dir, "supplier"), F.col("s_suppkey")
    old = s.where(k % 2 == 0).select(k.alias("rule_id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("threshold"))
    new = s.where(k % 3 == 0).select(k.alias("rule_id"), F.when(k % 5 != 0, F.concat(F.lit("new "), "s_name")).alias("title"), k.cast("double").alias("threshold"))
    return intake.merged_rules(old, new, ["rule_id"])


@query("new_receipts", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def new_receipts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    return intake.absent(o.select("o_custkey"), o.where("o_orderstatus = 'P'"), "o_custkey")


@query(
    "projected_states",
    f"""WITH {OBS} SELECT "offset", CASE k % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ambiguous' ELSE 'unresolved' END AS projected_entity_state, CASE k % 3 WHEN 0 THEN 'verified' ELSE 'unresolved' END AS projected_verification_state FROM obs""",
)
def projected_states(spark, sf_dir):
    k = F.col("k")
    c = observations(spark, sf_dir).select("offset", F.when(k % 4 == 0, "resolved").when(k % 4 == 1, "ambiguous").when(k % 4 == 2, "odd").alias("entity_state"), F.when(k % 3 == 0, "verified").when(k % 3 == 1, "unverified").alias("verification_state"))
    return intake.projected_states(c).select("offset", "projected_entity_state", "projected_verification_state")


@query("action_receipts", f"""WITH {OBS} SELECT "offset", {sql_hash('entity', 'category', 'city', 'ts_ms')} AS receipt_id FROM obs""")
def action_receipts(spark, sf_dir):
    a = observations(spark, sf_dir).select("offset", F.col("entity").alias("actor"), F.col("category").alias("action"), F.col("city").alias("subject"), F.col("ts_ms").alias("at_ms"))
    return intake.action_receipts(a).select("offset", "receipt_id")


_RULES = {"click": [{"role": "subject", "type": "organization", "names": ("payload.company", "payload.raw.name")}], "view": [{"role": "subject", "type": "any", "names": ("payload.company",), "ids": {"duns": ("payload.duns",), "ein": ("spacetime.county",)}}, {"role": "agency", "type": "government_agency", "names": ("spacetime.state",)}]}


@query(
    "entity_candidates",
    f"""WITH {OBS}, x AS (
  SELECT stream_id, "offset", 'subject' AS role, entity AS name, NULL AS id_value FROM obs WHERE stream_id = 'click'
  UNION ALL SELECT stream_id, "offset", 'subject', CASE WHEN k % 2 = 0 THEN entity END, city FROM obs WHERE stream_id = 'view' AND (k % 2 = 0 OR city IS NOT NULL)
  UNION ALL SELECT stream_id, "offset", 'agency', jurisdiction_id, NULL FROM obs WHERE stream_id = 'view' AND k % 5 <> 0)
SELECT * FROM x UNION ALL SELECT stream_id, "offset", 'ignored', NULL, NULL FROM obs WHERE (stream_id, "offset") NOT IN (SELECT (stream_id, "offset") FROM x)""",
)
def entity_candidates(spark, sf_dir):
    return intake.entity_candidates(_events(spark, sf_dir), _RULES).select("stream_id", "offset", "role", "name", "id_value")


@query(
    "adapter_outcomes",
    """WITH x AS (SELECT c_custkey, count(o_orderkey) AS after, count(o_orderkey) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS before FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'failed' WHEN after > before THEN 'productive' WHEN after > 0 THEN 'no_change' ELSE 'zero' END AS outcome FROM x""",
)
def adapter_outcomes(spark, sf_dir):
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("after"), F.count_if(F.col("o_orderdate") < F.expr("timestamp_ntz'2000-01-01 00:00:00'")).alias("before"))
    x = read(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").na.fill(0, ["after", "before"])
    return x.select("c_custkey", run_outcome(F.col("before"), F.col("after"), F.col("c_custkey") % 20 != 0).alias("outcome"))
