from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import identity, ledgers
from ..storage import cut, for_repeated_texts
from ..tables import OBS, RESENT, epoch_ms, joined_hash, observations, read, resent, sql_hash

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- resolutions: orders that name customers, some of them wrong in one of many ways ---

_MAN, _IDX = "a" * 64, "b" * 64
_FAULTS = ("missing_identity", "invalid_hash", "input_state_mismatch", "invalid_status", "missing_method", "resolved_without_entity", "entity_without_resolution", "unknown_event", "unknown_rule", "rule_of_other_stream", "rule_of_other_type", "role_mismatch", "type_mismatch", "field_not_allowed", "field_without_value", "value_without_field",
           "identifier_field_not_allowed", "identifier_kind_not_allowed", "identifier_without_field", "identifier_without_kind", "identifier_field_without_value", "fuzzy_method", "not_ignored", "ignored_by_other_rule", "event_hash_mismatch", "source_value_mismatch", "normalized_name_mismatch", "identifier_value_mismatch",
           "normalized_identifier_mismatch", "candidate_key_mismatch", "too_few_candidates", "entity_not_a_candidate", "inactive_candidate", "not_reproduced", "resolution_hash_mismatch")


def _batch(spark, sf_dir):
    """Resolutions of orders; every third order has the fault of its number."""
    li = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("s"))
    fault = F.get(F.array(*map(F.lit, _FAULTS)), F.when(F.col("k") % 3 == 0, (F.floor(F.col("k") / 3) % len(_FAULTS)).cast("int")).otherwise(-1))
    x = li.withColumn("fault", fault)
    is_ = lambda *names: F.coalesce(F.col("fault").isin(*names), F.lit(False))
    swap = lambda name, bad, good: F.when(is_(name), bad).otherwise(good)
    null, text = F.lit(None).cast("string"), lambda c: c.cast("string")
    name, ein = F.concat(F.lit("Supplier No "), text(F.col("s"))), F.concat(F.lit("12-"), F.lpad(text(F.col("s")), 7, "0"))
    key = F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")
    entity = F.concat(F.lit("s:"), text(F.col("s")))
    ambiguous = (F.col("s") % 7 == 0) & ~is_("entity_not_a_candidate", "resolved_without_entity", "entity_without_resolution", "not_reproduced") | is_("too_few_candidates")
    ignoring = is_("not_ignored")
    x = x.select(
        "k", "s", "fault", F.lit("lines").alias("stream_id"), F.when(is_("unknown_event"), -F.col("k")).otherwise(F.col("k")).alias("offset"), swap("event_hash_mismatch", F.sha2(text(-F.col("k")), 256), F.sha2(text(F.col("k")), 256)).alias("event_hash"),
        F.when(is_("unknown_rule"), "r9").when(is_("rule_of_other_stream"), "r2").when(is_("rule_of_other_type"), "r3").when(ignoring, "r4").otherwise("r1").alias("rule_id"), F.lit("1").alias("rule_version"), F.when(is_("missing_identity"), " ").when(is_("role_mismatch"), "other").otherwise("subject").alias("entity_role"),
        swap("type_mismatch", F.lit("any"), F.lit("organization")).alias("expected_type"), F.when(is_("field_not_allowed"), "payload.odd").when(is_("value_without_field"), "__none__").otherwise("payload.name").alias("source_field"),
        F.when(is_("field_without_value"), null).when(is_("source_value_mismatch"), F.lit("x")).otherwise(name).alias("source_value"), swap("normalized_name_mismatch", F.lit("X"), F.when(is_("field_without_value"), null).when(is_("source_value_mismatch"), F.lit("X")).otherwise(key)).alias("normalized_name"),
        F.when(is_("identifier_field_not_allowed"), "payload.odd").when(is_("identifier_without_field"), null).otherwise("payload.ein").alias("id_field"), F.when(is_("identifier_kind_not_allowed"), "duns").when(is_("identifier_without_kind"), null).otherwise("ein").alias("id_kind"),
        F.when(is_("identifier_field_without_value"), null).when(is_("identifier_value_mismatch"), F.lit("99-9999999")).otherwise(ein).alias("id_value"), F.when(is_("normalized_identifier_mismatch"), F.lit("1")).when(is_("identifier_value_mismatch"), F.lit("999999999")).otherwise(F.regexp_replace(ein, "-", "")).alias("normalized_id"),
        F.when(is_("invalid_status"), "maybe").when(is_("ignored_by_other_rule"), "ignored").when(ambiguous, "ambiguous").when(is_("entity_without_resolution", "not_reproduced"), "unresolved").otherwise("resolved").alias("status"), F.when(is_("missing_method"), " ").when(is_("fuzzy_method"), "Fuzzy_name").when(ambiguous, "duplicate_exact_name").otherwise("exact_external_identifier").alias("method"),
        F.when(ambiguous | is_("resolved_without_entity", "ignored_by_other_rule", "not_reproduced"), null).otherwise(entity).alias("entity_id"),
        F.when(is_("inactive_candidate"), F.array(entity, F.lit("s:none"))).when(is_("too_few_candidates"), F.array(entity, entity)).when(is_("entity_not_a_candidate"), F.array(F.lit("s:100000000"))).when(ambiguous, F.array(F.lit("s:1"), F.lit("s:2"))).otherwise(F.array(entity)).alias("candidates"),
        swap("input_state_mismatch", F.lit("c"), F.lit(_MAN)).alias("manifest_hash"), F.lit(_IDX).alias("index_hash"))
    x = x.withColumn("candidate_key", F.when(is_("candidate_key_mismatch"), F.lit("d" * 64)).otherwise(ledgers.candidate_key(*ledgers.KEY_FIELDS))).withColumn("candidates_text", F.array_join(F.array_sort("candidates"), ","))
    x = x.withColumn("resolution_hash", F.when(is_("invalid_hash"), F.lit("z")).when(is_("resolution_hash_mismatch"), F.lit("e" * 64)).otherwise(ledgers.resolution_hash()))
    fields = F.create_map(F.lit("payload.name"), name, F.lit("payload.ein"), ein, F.lit("payload.odd"), name)
    events = li.select(F.lit("lines").alias("stream_id"), F.col("k").alias("offset"), F.lit("order").alias("signal_type"), F.sha2(text(F.col("k")), 256).alias("event_hash"), fields.alias("fields"))
    rule = lambda r, stream, signal, ignores: (r, "1", stream, [signal], "subject", "organization", ["payload.name", "__none__"], ["payload.ein"], ["ein"], ignores)
    rules = spark.createDataFrame([rule("r1", "*", "*", False), rule("r2", "other", "*", False), rule("r3", "*", "shipment", False), rule("r4", "*", "*", True)], "rule_id string, rule_version string, stream_id string, signal_types array<string>, entity_role string, expected_type string, name_fields array<string>, id_fields array<string>, id_kinds array<string>, ignores boolean")
    s = read(spark, sf_dir, "customer").select(F.concat(F.lit("s:"), F.col("c_custkey").cast("string")).alias("entity_id")).union(spark.range(1).select(F.lit("s:100000000")))
    # what resolving again gives, by the key of a good row
    good = li.select("s").distinct()
    name, ein, entity, twice = F.concat(F.lit("Supplier No "), text(F.col("s"))), F.lpad(text(F.col("s")), 7, "0"), F.concat(F.lit("s:"), text(F.col("s"))), F.col("s") % 7 == 0
    good = good.select("s", F.lit("r1").alias("rule_id"), F.lit("1").alias("rule_version"), F.lit("subject").alias("entity_role"), F.lit("payload.name").alias("source_field"), F.regexp_replace(F.upper(name), "[^A-Z0-9]", "").alias("normalized_name"), F.lit("payload.ein").alias("id_field"), F.lit("ein").alias("id_kind"), F.concat(F.lit("12"), ein).alias("normalized_id"), F.lit("organization").alias("expected_type"),
                       F.when(twice, "ambiguous").otherwise("resolved").alias("want_status"), F.when(twice, "duplicate_exact_name").otherwise("exact_external_identifier").alias("want_method"), F.when(~twice, entity).alias("want_entity"), F.when(twice, F.array(F.lit("s:1"), F.lit("s:2"))).otherwise(F.array(entity)).alias("want_candidates"))
    want = good.select(ledgers.candidate_key(*ledgers.KEY_FIELDS).alias("candidate_key"), "want_status", "want_method", "want_entity", "want_candidates")
    return x, events, rules, s, want


def _checked(spark, sf_dir):
    x, events, rules, entities, want = _batch(spark, sf_dir)
    return ledgers.checked_resolutions(x.drop("s", "candidates_text"), events, rules, entities, want, _MAN, _IDX)


_FAULT = f"CASE WHEN k % 3 = 0 THEN [{', '.join(f"'{f}'" for f in _FAULTS)}][(k // 3) % {len(_FAULTS)} + 1] END"


@query("checked_resolutions", f"""WITH x AS (SELECT o_orderkey AS k FROM orders) SELECT k, {_FAULT} AS reason FROM x""")
def checked_resolutions(spark, sf_dir):
    return _checked(spark, sf_dir).select("k", "reason")


@query("persisted_resolutions", f"""WITH x AS (SELECT o_orderkey AS k FROM orders), g AS (SELECT k, {_FAULT} AS reason FROM x)
SELECT k, false AS is_old, true AS is_current FROM g WHERE reason IS NULL UNION ALL SELECT k, true, false FROM g WHERE reason IS NULL UNION ALL SELECT -k, true, true FROM g WHERE reason IS NULL""")
def persisted_resolutions(spark, sf_dir):
    good = cut(_checked(spark, sf_dir)).where("reason is null")
    old = good.drop("reason").withColumn("is_current", F.lit(True)).withColumn("resolution_hash", F.lit("f" * 64))
    other = old.withColumn("k", -F.col("k")).withColumn("offset", -F.col("offset"))
    x = ledgers.persisted_resolutions(good, old.unionByName(other), most=10**12)
    return x.select("k", (F.col("resolution_hash") == "f" * 64).alias("is_old"), "is_current")


@query(
    "fetched_review_queue",
    """WITH x AS (SELECT l_orderkey AS o, 'line' || l_linenumber AS stream_id, CASE l_returnflag WHEN 'A' THEN 'ambiguous' WHEN 'R' THEN 'unresolved' ELSE 'resolved' END AS status, l_suppkey % 40 AS name, l_shipmode AS role, epoch_us(l_shipdate) // 1000 AS ts_ms FROM (SELECT *, 'm' || (l_partkey % 3) AS l_shipmode FROM lineitem)),
g AS (SELECT status, role, name, count(DISTINCT (stream_id, o)) AS events, count(DISTINCT stream_id) AS streams, string_agg(DISTINCT stream_id, ',' ORDER BY stream_id) AS stream_ids, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM x WHERE status <> 'resolved' GROUP BY ALL)
SELECT *, """ + sql_hash("status", "role", "name") + """ AS review_key FROM g WHERE events >= 2 ORDER BY events DESC, streams DESC, last_ms DESC, review_key LIMIT 60""",
)
def fetched_review_queue(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("offset"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("stream_id"), F.when(F.col("l_returnflag") == "A", "ambiguous").when(F.col("l_returnflag") == "R", "unresolved").otherwise("resolved").alias("status"), (F.col("l_suppkey") % 40).alias("name"), F.concat(F.lit("m"), (F.col("l_partkey") % 3).cast("string")).alias("role"), epoch_ms("l_shipdate").alias("ts_ms"))
    return ledgers.review_queue(li, ["role", "name"], least=2, most=60)


@query("resolution_runs", """WITH r AS (SELECT 'run' || (l_suppkey % 12) AS run_id, CASE l_returnflag WHEN 'A' THEN 'ambiguous' WHEN 'R' THEN 'unresolved' ELSE 'resolved' END AS status, l_orderkey AS o, l_linenumber AS s FROM lineitem),
st AS (SELECT CASE WHEN n_nationkey = 5 THEN ' ' ELSE 'run' || n_nationkey END AS run_id, CASE WHEN n_nationkey = 6 THEN 5001 ELSE 500 END AS batch_size, CASE WHEN n_nationkey = 7 THEN 0 ELSE 13 END AS rule_count FROM nation),
c AS (SELECT run_id, count(*) AS rows, count(DISTINCT (s, o)) AS events, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unresolved') AS unresolved, CAST(0 AS BIGINT) AS ignored FROM r GROUP BY ALL),
j AS (SELECT st.run_id, batch_size, rule_count, CASE WHEN trim(run_id) = '' THEN 'missing_run_id' WHEN batch_size > 5000 THEN 'invalid_batch_size' WHEN rule_count < 1 THEN 'no_rules' END AS reason, coalesce(rows, 0) AS rows, coalesce(events, 0) AS events, coalesce(resolved, 0) AS resolved, coalesce(ambiguous, 0) AS ambiguous, coalesce(unresolved, 0) AS unresolved, coalesce(ignored, 0) AS ignored FROM st LEFT JOIN c USING (run_id))
SELECT *, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN rows > 0 THEN 'completed' ELSE 'started' END AS state FROM j""")
def resolution_runs(spark, sf_dir):
    n = F.col("n_nationkey")
    starts = read(spark, sf_dir, "nation").select(F.when(n == 5, " ").otherwise(F.concat(F.lit("run"), n.cast("string"))).alias("run_id"), F.when(n == 6, 5001).otherwise(500).alias("batch_size"), F.when(n == 7, 0).otherwise(13).alias("rule_count"))
    li = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("run"), (F.col("l_suppkey") % 12).cast("string")).alias("run_id"), F.when(F.col("l_returnflag") == "A", "ambiguous").when(F.col("l_returnflag") == "R", "unresolved").otherwise("resolved").alias("status"), F.col("l_linenumber").cast("string").alias("stream_id"), F.col("l_orderkey").alias("offset"))
    return ledgers.run_ledger(starts, li)


@query("candidate_unions", """WITH x AS (SELECT o_orderkey AS k, list_transform(range(o_orderkey % 4), lambda i: 'e' || ((o_orderkey + i) % 7)) AS a, CASE WHEN o_orderkey % 3 <> 0 THEN ['e' || (o_orderkey % 5), 'n' || (o_orderkey % 2)] END AS b FROM orders)
SELECT k, array_to_string(list_sort(list_distinct(list_concat(a, coalesce(b, [])))), ',') AS candidates FROM x""")
def candidate_unions(spark, sf_dir):
    k = F.col("o_orderkey")
    many = F.when(k % 4 > 0, F.transform(F.sequence(F.lit(0), (k % 4 - 1).cast("int")), lambda i: F.concat(F.lit("e"), ((k + i) % 7).cast("string"))))
    x = read(spark, sf_dir, "orders").select(k.alias("k"), many.alias("a"), F.when(k % 3 != 0, F.array(F.concat(F.lit("e"), (k % 5).cast("string")), F.concat(F.lit("n"), (k % 2).cast("string")))).alias("b"))
    return x.select("k", F.array_join(ledgers.candidate_union("a", "b"), ",").alias("candidates"))


@query("identity_best_rows", """SELECT l_suppkey AS entity_id, l_partkey % 20 AS input_hash, l_orderkey AS records, l_discount AS rate FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 20 ORDER BY l_discount DESC, l_orderkey DESC, l_linenumber, l_partkey) AS i FROM lineitem) WHERE i = 1""")
def identity_best_rows(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity_id"), (F.col("l_partkey") % 20).alias("input_hash"), F.col("l_orderkey").alias("records"), F.col("l_discount").alias("rate"), F.col("l_linenumber").alias("primary_name"), F.col("l_partkey").alias("normalized_name"))
    return ledgers.identity_best(li).drop("primary_name", "normalized_name")


@query(
    "entity_registry_upsert",
    """WITH st AS (SELECT s_suppkey AS entity_id, 'company' AS entity_type, s_name AS primary_name, 1 AS jurisdiction_count, true AS is_active FROM supplier WHERE s_suppkey % 2 = 0),
r AS (SELECT CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey % 150 END AS entity_id, CASE WHEN o_orderkey % 13 <> 0 THEN 'agency' END AS entity_type, 'n' || o_orderkey AS primary_name, CASE WHEN o_orderkey % 3 = 0 THEN 2 END AS jurisdiction_count, CASE WHEN o_orderkey % 5 = 0 THEN false END AS is_active, o_orderkey % 4 <> 0 AS ok, o_orderkey AS place FROM orders),
n AS (SELECT entity_id, entity_type, primary_name, coalesce(jurisdiction_count, 0) AS jurisdiction_count, coalesce(is_active, true) AS is_active FROM r WHERE entity_id IS NOT NULL AND entity_type IS NOT NULL AND ok QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY place DESC) = 1)
SELECT * FROM n UNION ALL SELECT * FROM st WHERE entity_id NOT IN (SELECT entity_id FROM n)""",
)
def entity_registry_upsert(spark, sf_dir):
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    stored = read(spark, sf_dir, "supplier").where(s % 2 == 0).select(s.alias("entity_id"), F.lit("company").alias("entity_type"), F.col("s_name").alias("primary_name"), F.lit(1).alias("jurisdiction_count"), F.lit(True).alias("is_active"))
    records = read(spark, sf_dir, "orders").select(F.when(k % 17 != 0, F.col("o_custkey") % 150).alias("entity_id"), F.when(k % 13 != 0, "agency").alias("entity_type"), F.concat(F.lit("n"), k.cast("string")).alias("primary_name"), F.when(k % 3 == 0, 2).alias("jurisdiction_count"), F.when(k % 5 == 0, False).alias("is_active"), F.when(k % 4 != 0, "deterministic_field_mapping").otherwise("guess").alias("extraction_method"), k.alias("place"))
    return ledgers.registry_upsert(stored, records)


@query(
    "civic_signal_reasons",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'not_deterministic' WHEN o_orderkey % 5 = 0 THEN 'missing_source_url' WHEN o_orderkey % 7 = 0 THEN 'missing_statute_id' WHEN o_orderkey % 11 = 0 THEN 'type_not_allowed' END AS reason FROM orders""",
)
def civic_signal_reasons(spark, sf_dir):
    return ledgers.civic_signals(_civic(spark, sf_dir, True)).select("raw_record_id", "reason").withColumnRenamed("raw_record_id", "o_orderkey")


def _civic(spark, sf_dir, faulty):
    k = F.col("o_orderkey")
    bad = lambda m, r: (k % m == r) & F.lit(faulty)
    return read(spark, sf_dir, "orders").select(
        F.when(bad(4, 1), "model").otherwise("deterministic_rule").alias("generation_method"), F.when(bad(5, 0), " ").otherwise("http://x").alias("source_url"), k.alias("raw_record_id"), F.when(~bad(7, 0), F.col("o_custkey") % 90).alias("statute_id"), (k % 3).alias("connector_id"), F.lit("rule").alias("rule_id"),
        F.when(bad(11, 0), "rumour").otherwise("new_statute_or_bill").alias("signal_type"), F.concat(F.lit("g"), k.cast("string")).alias("geography_key"), (k % 100 / 100).alias("confidence"), k.alias("place"))


@query(
    "civic_signal_upsert",
    """WITH st AS (SELECT DISTINCT o_custkey % 120 AS statute_id, 0::BIGINT AS connector_id, 'rule' AS rule_id, 'new_statute_or_bill' AS signal_type, 'old' AS geography_key, 0.5::DOUBLE AS confidence FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT o_custkey % 90 AS statute_id, o_orderkey % 3 AS connector_id, 'rule' AS rule_id, 'new_statute_or_bill' AS signal_type, 'g' || o_orderkey AS geography_key, (o_orderkey % 100) / 100.0::DOUBLE AS confidence FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 90, o_orderkey % 3 ORDER BY o_orderkey DESC) = 1)
SELECT connector_id, signal_type, statute_id, rule_id, CASE WHEN st.geography_key IS NOT NULL THEN st.geography_key ELSE n.geography_key END AS geography_key, round(coalesce(n.confidence, st.confidence), 6) AS confidence FROM st FULL JOIN n USING (connector_id, signal_type, statute_id, rule_id)""",
)
def civic_signal_upsert(spark, sf_dir):
    o = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    stored = o.select((F.col("o_custkey") % 120).alias("statute_id"), F.lit(0).cast("long").alias("connector_id"), F.lit("rule").alias("rule_id"), F.lit("new_statute_or_bill").alias("signal_type"), F.lit("old").alias("geography_key"), F.lit(0.5).alias("confidence")).distinct()
    x = ledgers.civic_upsert(stored, ledgers.civic_signals(_civic(spark, sf_dir, False)))
    return x.withColumn("confidence", F.round("confidence", 6))


# --- ingest in batches that stop ---

_BATCH = """b AS (SELECT o_custkey AS batch_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, CASE WHEN o_custkey % 19 = 0 THEN 's' || (o_orderkey % 2) ELSE 's' || (o_custkey % 4) END AS stream_id, o_orderkey % 23 = 0 AS bad, 'h' || (o_orderkey % 400) AS identity_hash FROM orders),
known AS (SELECT DISTINCT 's' || (o_custkey % 4) AS stream_id, 'h' || (o_orderkey % 400) AS identity_hash FROM orders WHERE o_orderkey % 400 < 40), kn AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY identity_hash) - 1 AS canonical_offset FROM known),
per AS (SELECT batch_id, min(CASE WHEN bad THEN place END) AS stop, count(DISTINCT stream_id) AS streams FROM b GROUP BY ALL),
x AS (SELECT b.*, CASE WHEN streams > 1 THEN 'refused' WHEN place = stop THEN 'failed' WHEN place > stop THEN 'not_reached' END AS state FROM b JOIN per USING (batch_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY stream_id, identity_hash ORDER BY batch_id, place) AS nth FROM x WHERE state IS NULL),
new AS (SELECT f.stream_id, f.identity_hash, (SELECT coalesce(max(canonical_offset) + 1, 0) FROM kn WHERE kn.stream_id = f.stream_id) + row_number() OVER (PARTITION BY f.stream_id ORDER BY batch_id, place) - 1 AS new_offset FROM f LEFT JOIN kn USING (stream_id, identity_hash) WHERE nth = 1 AND canonical_offset IS NULL),
rows_ AS (SELECT x.batch_id, x.place, x.stream_id, x.identity_hash, CASE WHEN x.state IS NOT NULL THEN x.state WHEN f.nth = 1 AND canonical_offset IS NULL THEN 'inserted' ELSE 'replayed' END AS outcome, CASE WHEN x.state IS NULL THEN coalesce(canonical_offset, new_offset) END AS "offset"
  FROM x LEFT JOIN f USING (batch_id, place) LEFT JOIN kn ON kn.stream_id = x.stream_id AND kn.identity_hash = x.identity_hash LEFT JOIN new ON new.stream_id = x.stream_id AND new.identity_hash = x.identity_hash)"""


def _batches(spark, sf_dir):
    from pyspark.sql import Window as W

    o, k, c = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    s = lambda x: F.concat(F.lit("s"), x.cast("string"))
    h = F.concat(F.lit("h"), (k % 400).cast("string")).alias("identity_hash")
    batch = o.select(c.alias("batch_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("place"), F.when(c % 19 == 0, s(k % 2)).otherwise(s(c % 4)).alias("stream_id"), F.when(k % 23 == 0, " ").otherwise("t").alias("timestamp"), *(F.lit("x").alias(n) for n in ("signal_type", "source_id", "jurisdiction_id", "module_hint")), h)
    known = o.where(k % 400 < 40).select(s(c % 4).alias("stream_id"), h).distinct()
    known = known.withColumn("canonical_offset", F.row_number().over(W.partitionBy("stream_id").orderBy("identity_hash")).cast("long") - 1)
    return ledgers.batch_outcome(batch, known)


@query("batch_outcomes", f"WITH {_BATCH} SELECT * FROM rows_")
def batch_outcomes(spark, sf_dir):
    return _batches(spark, sf_dir)[0]


@query(
    "batch_runs",
    f"""WITH {_BATCH}, r AS (SELECT batch_id, count(*) AS seen, count(*) FILTER (outcome = 'inserted') AS inserted, count(*) FILTER (outcome = 'replayed') AS replayed, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'not_reached') AS not_reached, count(*) FILTER (outcome = 'refused') AS refused, max("offset") AS cursor_after FROM rows_ GROUP BY ALL)
SELECT *, CASE WHEN refused > 0 THEN 'refused' WHEN failed = 0 THEN 'completed' WHEN inserted + replayed > 0 THEN 'partial' ELSE 'failed' END AS status FROM r""",
)
def batch_runs(spark, sf_dir):
    return _batches(spark, sf_dir)[1]


@query("batch_receipts", f"""WITH {_BATCH} SELECT * FROM rows_ WHERE outcome IN ('inserted', 'replayed') QUALIFY row_number() OVER (PARTITION BY batch_id ORDER BY place) <= 50""")
def batch_receipts(spark, sf_dir):
    return _batches(spark, sf_dir)[2]


# --- exports, catalogs, bundles ---

_LEDGER = f"""{RESENT}, led AS (SELECT stream_id, identity_hash, min("offset") AS canonical_offset, max(ingested_ms) AS last_seen_ms FROM resent GROUP BY ALL)"""


def _export(spark, sf_dir):
    r = resent(spark, sf_dir)
    allowed = r.select("stream_id").distinct().withColumn("enabled", ~F.col("stream_id").isin("error"))
    return identity.ledger(r).select("stream_id", "canonical_offset", "last_seen_ms"), r.select("stream_id", "offset", "ts_ms", "category"), allowed


@query("exported_events", f"""WITH {_LEDGER} SELECT r.stream_id, r."offset", ts_ms, category, last_seen_ms AS ingested_ms FROM resent r JOIN led ON led.stream_id = r.stream_id AND led.canonical_offset = r."offset" WHERE r.stream_id <> 'error'""")
def exported_events(spark, sf_dir):
    led, events, allowed = _export(spark, sf_dir)
    return ledgers.exported(led, events, allowed)


@query("export_page", f"""WITH {_LEDGER} SELECT r.stream_id, r."offset", ts_ms, category, last_seen_ms AS ingested_ms FROM resent r JOIN led ON led.stream_id = r.stream_id AND led.canonical_offset = r."offset" WHERE r.stream_id = 'click' AND r."offset" >= 100 ORDER BY r."offset" LIMIT 200""")
def export_page(spark, sf_dir):
    return ledgers.export_page(*_export(spark, sf_dir), "click", 100, 200)


@query("prime_pattern_page", f"""WITH {OBS} SELECT "offset" AS pattern_id, category AS module, jurisdiction_id AS jurisdiction, ts_ms AS detected_ms FROM obs WHERE category = 'cat_7' AND jurisdiction_id = 'ASIA' AND ts_ms >= 1704500000000 ORDER BY ts_ms DESC, "offset" LIMIT 1000""")
def prime_pattern_page(spark, sf_dir):
    p = observations(spark, sf_dir).select(F.col("offset").alias("pattern_id"), F.col("category").alias("module"), F.col("jurisdiction_id").alias("jurisdiction"), F.col("ts_ms").alias("detected_ms"))
    return ledgers.prime_patterns(p, "cat_7", "ASIA", 1_704_500_000_000)


@query("stream_catalog_counts", """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 <> 0 THEN 'm' || (s_suppkey % 5) END AS module, CAST(s_nationkey AS VARCHAR) AS jurisdiction FROM supplier)
SELECT 'module' AS "group", coalesce(module, 'unknown') AS name, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'jurisdiction', jurisdiction, count(*) FROM s GROUP BY ALL UNION ALL SELECT 'total', 'streams', count(*) FROM s""")
def stream_catalog_counts(spark, sf_dir):
    s = F.col("s_suppkey")
    return ledgers.catalog_summary(ledgers.whole(read(spark, sf_dir, "supplier").select(F.when(s % 7 != 0, F.concat(F.lit("m"), (s % 5).cast("string"))).alias("module"), F.col("s_nationkey").alias("jurisdiction"))), "module", "jurisdiction")


@query("run_bundles", """SELECT c_custkey AS run_key, '{"run_key":' || c_custkey || ',"level":"' || c_mktsegment || '"}' AS manifest, coalesce((SELECT '[' || string_agg('{"geography":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' FROM orders WHERE o_custkey = c_custkey), '[]') AS receipts FROM customer""")
def run_bundles(spark, sf_dir):
    m = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_key"), F.col("c_mktsegment").alias("level"), F.lit(1).alias("persisted_ms"))
    return ledgers.run_bundle(m, read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_key"), F.col("o_orderkey").alias("geography"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("persisted_ms")))


@query("traits_of_versions", """WITH t AS (SELECT l_suppkey % 50 AS run_id, list_sort(list(l_orderkey * 10 + l_linenumber)) AS t FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL) SELECT p_partkey AS version_key, p_partkey % 60 AS run_id, coalesce(array_to_string(t, ','), '') AS traits FROM part LEFT JOIN t ON run_id = p_partkey % 60""")
def traits_of_versions(spark, sf_dir):
    spark = for_repeated_texts(spark, "traits")
    v = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("version_key"), (F.col("p_partkey") % 60).alias("run_id"))
    t = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trait_id"), F.when(F.col("l_linenumber") != 7, F.col("l_suppkey") % 50).alias("run_id"))
    return ledgers.traits_by_run(v, t, ",")


@query(
    "runtime_snapshot",
    """WITH s AS (SELECT c_custkey AS stream_id, c_mktsegment AS status FROM customer), a AS (SELECT c_custkey AS stream_id, 'a' || c_custkey AS adapter, c_custkey % 3 AS priority, 3600000 * (6 + c_custkey % 5) + 100 AS interval_ms FROM customer WHERE c_custkey % 4 = 0),
r AS (SELECT o_custkey AS stream_id, epoch_us(o_orderdate) // 1000 AS completed_ms, o_orderstatus AS outcome, o_orderpriority AS error FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY completed_ms DESC, outcome DESC, error DESC) = 1)
SELECT stream_id, status, adapter IS NOT NULL AS runnable, adapter, priority, CAST(round(interval_ms / 3600000) AS BIGINT) AS interval_hours, outcome AS last_outcome, completed_ms AS last_run_ms, error AS last_error FROM s LEFT JOIN a USING (stream_id) LEFT JOIN r USING (stream_id)""",
)
def runtime_snapshot(spark, sf_dir):
    c = F.col("c_custkey")
    s = read(spark, sf_dir, "customer")
    a = s.where(c % 4 == 0).select(c.alias("stream_id"), F.concat(F.lit("a"), c.cast("string")).alias("adapter"), (c % 3).alias("priority"), (3_600_000 * (6 + c % 5) + 100).alias("interval_ms"))
    r = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("target_id"), epoch_ms("o_orderdate").alias("completed_ms"), F.col("o_orderstatus").alias("outcome"), F.col("o_orderpriority").alias("error"))
    return ledgers.runtime_snapshot(s.select(c.alias("stream_id"), F.col("c_mktsegment").alias("status")), a, r)


@query("health_reconciliation", """SELECT count(DISTINCT o_orderkey) AS jobs_seen, count(*) AS receipts_processed, count(*) FILTER (o_orderstatus <> 'F') AS persisted_count, count(*) FILTER (o_orderstatus = 'F') AS idempotent_count FROM orders""")
def health_reconciliation(spark, sf_dir):
    h = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), joined_hash(F.col("o_orderkey")).alias("receipt_hash"), "o_orderstatus")
    return ledgers.reconciled(h.drop("o_orderstatus"), h.where("o_orderstatus = 'F'"))


@query("bridge_receipt_totals", """WITH s AS (SELECT l_suppkey AS run_id, CAST(sum(l_linenumber) AS BIGINT) AS candidates_seen, count(*) FILTER (l_returnflag = 'A') AS bridged, count(*) FILTER (l_returnflag = 'N') AS idempotent, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) AS receipts FROM lineitem GROUP BY ALL), e AS (SELECT o_custkey % 150 AS run_id, count(*) AS n FROM orders GROUP BY ALL)
SELECT run_id, coalesce(candidates_seen, 0) AS candidates_seen, coalesce(bridged, 0) AS bridged, coalesce(idempotent, 0) AS idempotent, coalesce(failed, 0) + coalesce(n, 0) AS failed, coalesce(receipts, 0) AS receipts FROM s FULL JOIN e USING (run_id)""")
def bridge_receipt_totals(spark, sf_dir):
    flag = lambda f, n: (F.col("l_returnflag") == f).cast("int").alias(n)
    r = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_linenumber").alias("candidates_seen"), flag("A", "bridged"), flag("N", "idempotent"), flag("R", "failed"))
    return ledgers.bridge_totals(r, read(spark, sf_dir, "orders").select((F.col("o_custkey") % 150).alias("run_id")))
