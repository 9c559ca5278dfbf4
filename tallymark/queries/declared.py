from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import declared
from ..tables import epoch_ms, read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _events(spark, sf_dir):
    """Orders as delivered events of five kinds; fields stand where different sources put them, some are
    missing and some are not what they should be."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    party = text("c:", F.col("o_custkey"))
    kind = F.element_at(F.array(*map(F.lit, ("entity_registration", "Financial_Transfer ", "legislative_action", "source_assertion", "numeric_observation", "other"))), (k % 6 + 1).cast("int"))
    declared_ = F.struct(
        F.when(k % 10 != 7, kind).alias("kind"), F.when(k % 5 != 0, party).alias("canonical_entity_id"), F.when(k % 5 != 0, party).alias("from_entity_id"), F.when(k % 13 != 0, text("n:", k % 25)).alias("recipient_entity_id"), F.when(k % 5 != 0, party).otherwise(text("a b:", k)).alias("actor_entity_id"),
        F.when(k % 17 == 0, F.lit("0")).when(k % 17 == 1, F.lit("much")).otherwise(text(k % 1000, ".5")).alias("amount"), F.when(k % 4 == 0, F.array(F.lit("Water "), F.lit("land"), F.lit("water"))).alias("policy_tags"), party.alias("subject_id"), F.lit(" Head  Office ").alias("predicate"), F.when(k % 7 != 0, text("No ", k % 9)).alias("value"),
        F.lit("Cost").alias("metric"), (k % 50).alias("actual"), F.when(k % 8 < 4, F.lit(10)).alias("expected_min"), F.when(k % 8 == 5, F.lit(40.5)).alias("expected_max"),
        F.when(k % 3 != 1, F.create_map(F.lit("EIN "), F.array(text("X", k % 31), text(" x", k % 31), F.lit(None).cast("string")), F.lit("Phone"), F.array(text(k % 11)))).alias("exact_identifiers"))
    raw = F.struct(text("raw:", k).alias("entity_id"), F.lit("taxes; roads").alias("subject"))
    payload = F.struct(declared_.alias("integrity_observation"), raw.alias("raw"), F.when(k % 2 == 0, F.lit(" Some  Body")).alias("entity_name"), F.when(k % 10 == 7, text("from:", k)).alias("donor_entity_id"))
    event = F.struct(F.when(k % 10 == 7, F.lit("campaign_contribution")).alias("signal_type"), F.when(k % 19 != 0, day).otherwise("some day").alias("timestamp"), payload.alias("payload"), F.struct(F.when(k % 2 == 1, F.lit("WA")).alias("jurisdiction")).alias("spacetime"), F.when(k % 4 == 1, text("src", k % 3)).alias("source_id"))
    return declared.parsed(o.select(F.lit("orders").alias("stream_id"), k.alias("offset"), F.to_json(event).alias("event")))


_EV = """ev AS (SELECT o_orderkey AS k, 'orders' AS stream_id, o_orderkey AS "offset", 'c:' || o_custkey AS party, epoch_us(date_trunc('day', o_orderdate)) // 1000 AS day_ms, CASE WHEN o_orderkey % 10 <> 7 THEN o_orderkey % 6 END AS kind,
  o_orderkey % 10 = 7 AS gift, CASE WHEN o_orderkey % 2 = 1 THEN 'WA' ELSE 'unknown' END AS jurisdiction_id, o_orderkey % 19 <> 0 AS timed FROM orders)"""


@query("declared_entities", f"""WITH {_EV} SELECT stream_id, "offset", coalesce(CASE WHEN k % 5 <> 0 THEN party END, 'raw:' || k) AS entity_id, CASE WHEN k % 2 = 0 THEN 'Some Body' ELSE coalesce(CASE WHEN k % 5 <> 0 THEN party END, 'raw:' || k) END AS label, jurisdiction_id FROM ev WHERE kind = 0 OR k % 3 <> 1""")
def declared_entities(spark, sf_dir):
    return declared.entities(_events(spark, sf_dir)).select("stream_id", "offset", "entity_id", "label", "jurisdiction_id")


@query("declared_identifiers", f"""WITH {_EV} SELECT stream_id, "offset", 'ein' AS kind, 'x' || (k % 31) AS value FROM ev WHERE k % 3 <> 1 UNION ALL SELECT stream_id, "offset", 'phone', CAST(k % 11 AS VARCHAR) FROM ev WHERE k % 3 <> 1""")
def declared_identifiers(spark, sf_dir):
    return declared.identifiers(_events(spark, sf_dir))


@query(
    "declared_transfers",
    f"""WITH {_EV} SELECT 'orders:' || k AS transfer_id, coalesce(CASE WHEN k % 5 <> 0 THEN party END, CASE WHEN gift THEN 'from:' || k END) AS from_id, 'n:' || (k % 25) AS to_id, (k % 1000) + 0.5::DOUBLE AS amount, day_ms AS ts_ms,
  CASE WHEN k % 4 = 0 THEN 'land,water' ELSE '' END AS tags, jurisdiction_id FROM ev WHERE (kind = 1 OR gift) AND (k % 5 <> 0 OR gift) AND k % 13 <> 0 AND k % 17 > 1 AND timed""",
)
def declared_transfers(spark, sf_dir):
    return declared.transfers(_events(spark, sf_dir)).select("transfer_id", "from_id", "to_id", "amount", "ts_ms", F.array_join("tags", ",").alias("tags"), "jurisdiction_id")


@query("declared_actions", f"""WITH {_EV} SELECT 'orders:' || k AS action_id, party AS actor_id, day_ms AS ts_ms, CASE WHEN k % 4 = 0 THEN 'land,water' ELSE 'roads,taxes' END AS tags FROM ev WHERE kind = 2 AND k % 5 <> 0 AND timed""")
def declared_actions(spark, sf_dir):
    return declared.actions(_events(spark, sf_dir)).select("action_id", "actor_id", "ts_ms", F.array_join("tags", ",").alias("tags"))


@query("declared_assertions", f"""WITH {_EV} SELECT 'orders:' || k AS assertion_id, party AS subject, 'head office' AS predicate, 'No ' || (k % 9) AS value, CASE WHEN k % 4 = 1 THEN 'src' || (k % 3) ELSE 'orders' END AS source FROM ev WHERE kind = 3 AND k % 7 <> 0""")
def declared_assertions(spark, sf_dir):
    return declared.assertions(_events(spark, sf_dir)).select("assertion_id", "subject", "predicate", "value", "source")


@query("declared_numbers", f"""WITH {_EV} SELECT 'orders:' || k AS observation_id, party AS subject, 'cost' AS metric, (k % 50)::DOUBLE AS actual, CASE WHEN k % 8 < 4 THEN 10::DOUBLE END AS least, CASE WHEN k % 8 = 5 THEN 40.5::DOUBLE END AS most FROM ev WHERE kind = 4 AND (k % 8 < 4 OR k % 8 = 5)""")
def declared_numbers(spark, sf_dir):
    return declared.numbers(_events(spark, sf_dir)).select("observation_id", "subject", "metric", "actual", "least", "most")


# --- tables as the ontology's: signals with types and receipts, rules with candidates, runs with receipts ---

from ..operators import ontology  # noqa: E402

_ONT = """types AS (SELECT n_nationkey AS type_id, n_name AS type_code, n_regionkey AS category FROM nation WHERE n_nationkey < 22),
sig AS (SELECT o_orderkey AS signal_id, o_custkey % 25 AS type_id, o_orderpriority AS source_domain, CASE WHEN o_orderkey % 6 <> 0 THEN 'f' || o_orderkey END AS fingerprint, o_orderkey % 11 = 0 AS is_suppressed, CASE WHEN o_orderkey % 9 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS confidence, epoch_us(o_orderdate) // 1000 AS detected_ms FROM orders),
extraction AS (SELECT l_orderkey AS signal_id FROM lineitem WHERE l_returnflag = 'A'),
rules AS (SELECT 'r' || s_suppkey AS rule_id, s_suppkey % 2 AS rule_version, s_suppkey % 5 <> 0 AS is_active FROM supplier),
cand AS (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, 'r' || l_suppkey AS rule_id, l_linenumber % 2 AS rule_version, CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'R' THEN 'disputed' END AS verification_state, CASE l_linenumber % 4 WHEN 0 THEN 'bridged' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' END AS status, epoch_us(l_shipdate) // 1000 AS detected_ms FROM lineitem),
runs AS (SELECT c_custkey AS run_key, c_custkey % 7 AS total_source_rows, c_custkey * 1000 AS persisted_ms FROM customer), receipts AS (SELECT o_custkey AS run_key, o_orderstatus = 'F' AS detected, CASE o_orderstatus WHEN 'P' THEN 'unresolved' ELSE 'resolved' END AS status FROM orders)"""


def _ontology(spark, sf_dir):
    n, o, li, s, c = (read(spark, sf_dir, t) for t in ("nation", "orders", "lineitem", "supplier", "customer"))
    k, line = F.col("o_orderkey"), F.col("l_linenumber")
    return {
        "types": n.where("n_nationkey < 22").select(F.col("n_nationkey").alias("type_id"), F.col("n_name").alias("type_code"), F.col("n_regionkey").alias("category")),
        "signals": o.select(k.alias("signal_id"), (F.col("o_custkey") % 25).cast("int").alias("type_id"), F.col("o_orderpriority").alias("source_domain"), F.when(k % 6 != 0, F.concat(F.lit("f"), k.cast("string"))).alias("fingerprint"), (k % 11 == 0).alias("is_suppressed"), F.when(k % 9 != 0, (k % 100) / 100.0).alias("confidence"), epoch_ms("o_orderdate").alias("detected_ms")),
        "extractions": li.where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("signal_id")),
        "rules": s.select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("rule_id"), (F.col("s_suppkey") % 2).cast("int").alias("rule_version"), (F.col("s_suppkey") % 5 != 0).alias("is_active")),
        "candidates": li.select((F.col("l_orderkey") * 10 + line).alias("candidate_id"), F.concat(F.lit("r"), F.col("l_suppkey").cast("string")).alias("rule_id"), (line % 2).alias("rule_version"), F.when(F.col("l_returnflag") == "A", "verified").when(F.col("l_returnflag") == "R", "disputed").alias("verification_state"),
                               F.when(line % 4 == 0, "bridged").when(line % 4 == 1, "pending").when(line % 4 == 2, "failed").alias("status"), epoch_ms("l_shipdate").alias("detected_ms")),
        "runs": c.select(F.col("c_custkey").alias("run_key"), (F.col("c_custkey") % 7).alias("total_source_rows"), (F.col("c_custkey") * 1000).alias("persisted_ms")),
        "receipts": o.select(F.col("o_custkey").alias("run_key"), (F.col("o_orderstatus") == "F").alias("detected"), F.when(F.col("o_orderstatus") == "P", "unresolved").otherwise("resolved").alias("status")),
    }


@query(
    "canonical_signal_types",
    f"""WITH {_ONT}, r AS (SELECT signal_id, count(*) AS n FROM extraction GROUP BY ALL) SELECT type_code, category, source_domain, count(*) AS signals, count(fingerprint) AS fingerprinted, count(*) FILTER (is_suppressed) AS suppressed, count(*) FILTER (coalesce(n, 0) > 0) AS receipted,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS extraction_receipts, round(avg(confidence), 6) AS mean_confidence, min(detected_ms) AS first_ms, max(detected_ms) AS last_ms FROM sig JOIN types USING (type_id) LEFT JOIN r USING (signal_id) GROUP BY ALL""",
)
def canonical_signal_types(spark, sf_dir):
    t = _ontology(spark, sf_dir)
    return ontology.signal_types(t["signals"], t["types"], t["extractions"])


@query(
    "candidate_rule_summary",
    f"""WITH {_ONT} SELECT r.rule_id, CAST(r.rule_version AS INT) AS rule_version, is_active, count(candidate_id) AS candidates, count(candidate_id) FILTER (verification_state = 'verified') AS verified, count(candidate_id) FILTER (status = 'bridged') AS bridged, count(candidate_id) FILTER (status = 'pending') AS pending,
  count(candidate_id) FILTER (status = 'failed') AS failed, min(detected_ms) AS first_ms, max(detected_ms) AS last_ms FROM rules r LEFT JOIN cand c ON c.rule_id = r.rule_id AND c.rule_version = r.rule_version GROUP BY ALL""",
)
def candidate_rule_summary(spark, sf_dir):
    t = _ontology(spark, sf_dir)
    return ontology.candidate_rules(t["rules"], t["candidates"])


_RUNS = "run_sum AS (SELECT runs.*, coalesce(d, 0) AS detected, coalesce(r, 0) AS resolved, coalesce(u, 0) AS unresolved FROM runs LEFT JOIN (SELECT run_key, count(*) FILTER (detected) AS d, count(*) FILTER (status = 'resolved') AS r, count(*) FILTER (status <> 'resolved') AS u FROM receipts GROUP BY ALL) USING (run_key))"


@query("convergence_run_summary", f"WITH {_ONT}, {_RUNS} SELECT * FROM run_sum")
def convergence_run_summary(spark, sf_dir):
    t = _ontology(spark, sf_dir)
    return ontology.run_summary(t["runs"], t["receipts"])


@query(
    "derivation_summary",
    f"""WITH {_ONT}, {_RUNS}, latest AS (SELECT * FROM run_sum ORDER BY persisted_ms DESC, run_key LIMIT 1) SELECT (SELECT count(*) FROM sig) AS canonical_signals, (SELECT count(DISTINCT type_id) FROM sig) AS canonical_signal_types, (SELECT count(*) FROM sig WHERE signal_id IN (SELECT signal_id FROM extraction)) AS receipted_signals,
  (SELECT count(*) FROM sig WHERE signal_id NOT IN (SELECT signal_id FROM extraction)) AS unreceipted_signals, (SELECT count(*) FROM extraction) AS extraction_receipts, (SELECT max(detected_ms) FROM sig) AS latest_signal_ms, (SELECT count(*) FROM cand) AS candidates,
  (SELECT count(*) FROM cand WHERE verification_state = 'verified') AS verified_candidates, (SELECT count(*) FROM cand WHERE status = 'bridged') AS bridged_candidates, (SELECT count(*) FROM cand WHERE status = 'pending') AS pending_candidates, (SELECT max(detected_ms) FROM cand) AS latest_candidate_ms,
  (SELECT count(*) FROM rules) AS rule_versions, (SELECT count(*) FROM rules WHERE is_active) AS active_rules, (SELECT count(*) FROM runs) AS convergence_runs, (SELECT count(*) FROM receipts) AS convergence_receipts, run_key AS latest_run, total_source_rows AS latest_source_rows, detected AS latest_detected, persisted_ms AS latest_ms FROM latest""",
)
def derivation_summary(spark, sf_dir):
    return ontology.derivation(**_ontology(spark, sf_dir))
