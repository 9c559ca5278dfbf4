from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import currentness, graph, health, readmodels
from ..tables import DAY_MS, OBS, RESENT, epoch_ms, joined_hash, observations, read, resent, sql_hash

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- summaries ---


@query(
    "stream_dimension_summary",
    f"""WITH {OBS}, s AS (SELECT DISTINCT stream_id FROM obs UNION SELECT 'silent'), a AS (SELECT stream_id, count(*) AS n, count(DISTINCT entity) AS entities, min(ts_ms) AS first_ms FROM obs GROUP BY ALL)
SELECT stream_id, coalesce(n, 0) AS n, entities, first_ms FROM s LEFT JOIN a USING (stream_id)""",
)
def stream_dimension_summary(spark, sf_dir):
    obs = observations(spark, sf_dir)
    dim = obs.select("stream_id").distinct().union(spark.range(1).select(F.lit("silent")))
    return readmodels.dimension_summary(dim, obs, "stream_id", entities=F.count_distinct("entity"), first_ms=F.min("ts_ms"))


@query("signal_type_summary", f"""WITH {OBS} SELECT category, count(*) AS n, count(*) FILTER (confidence IS NOT NULL) AS with_confidence, round(avg(confidence), 9) AS average, count(DISTINCT stream_id) AS streams, max(ts_ms) AS newest_ms FROM obs GROUP BY category""")
def signal_type_summary(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("confidence").isNotNull()).alias("with_confidence"), F.round(F.avg("confidence"), 9).alias("average"), F.count_distinct("stream_id").alias("streams"), F.max("ts_ms").alias("newest_ms"))


@query(
    "substrate_summary",
    f"""WITH {RESENT} SELECT (SELECT count(*) FROM resent) AS events, (SELECT count(DISTINCT identity_hash) FROM resent) AS identities, (SELECT count(DISTINCT stream_id) FROM resent) AS streams, (SELECT count(*) FROM resent WHERE confidence IS NULL) AS unknown_confidence,
  (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers, (SELECT max(ts_ms) FROM resent) AS newest_ms""",
)
def substrate_summary(spark, sf_dir):
    r = resent(spark, sf_dir).agg(F.count("*").alias("events"), F.count_distinct("identity_hash").alias("identities"), F.count_distinct("stream_id").alias("streams"), F.count_if(F.col("confidence").isNull()).alias("unknown_confidence"), F.max("ts_ms").alias("newest_ms"))
    one = lambda t, n: read(spark, sf_dir, t).agg(F.count("*").alias(n))
    return r.crossJoin(one("customer", "customers")).crossJoin(one("supplier", "suppliers"))


@query("table_counts", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def table_counts(spark, sf_dir):
    return readmodels.counts_of({t: read(spark, sf_dir, t) for t in ("customer", "supplier", "part", "events")})


@query(
    "unique_registry_match",
    """WITH r AS (SELECT c_nationkey || '-' || (c_custkey % 60) AS name, c_custkey FROM customer), g AS (SELECT name, count(*) AS match_count, min(c_custkey) AS v FROM r GROUP BY name),
s AS (SELECT s_suppkey, s_nationkey || '-' || (s_suppkey % 60) AS name FROM supplier)
SELECT s_suppkey, name, coalesce(match_count, 0) AS match_count, CASE WHEN match_count = 1 THEN v END AS c_custkey FROM s LEFT JOIN g USING (name)""",
)
def unique_registry_match(spark, sf_dir):
    name = lambda a, b: F.concat_ws("-", F.col(a).cast("string"), (F.col(b) % 60).cast("string")).alias("name")
    reg = read(spark, sf_dir, "customer").select(name("c_nationkey", "c_custkey"), "c_custkey")
    return readmodels.unique_lookup(read(spark, sf_dir, "supplier").select("s_suppkey", name("s_nationkey", "s_suppkey")), reg, "name", "c_custkey")


@query(
    "newest_per_key",
    """SELECT o_custkey, o_orderkey, epoch_us(d) // 1000 AS newest_ms FROM (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderdate END AS d FROM orders) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY d DESC NULLS LAST, o_orderkey) = 1""",
)
def newest_per_key(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, epoch_ms("o_orderdate")).alias("newest_ms"))
    return readmodels.keep_newest(o, ["o_custkey"], "newest_ms", "o_orderkey")


@query("status_counts", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders")
def status_counts(spark, sf_dir):
    return readmodels.status_counts(read(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O", "P"])


@query(
    "trait_state_maps",
    """WITH c AS (SELECT p_brand, p_size % 5 AS s, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, string_agg(s || ':' || n, ',' ORDER BY CAST(s AS VARCHAR)) AS states FROM c GROUP BY p_brand""",
)
def trait_state_maps(spark, sf_dir):
    return readmodels.count_map(read(spark, sf_dir, "part").withColumn("s", F.col("p_size") % 5), ["p_brand"], "s", "states")


@query("pin_search", """SELECT * FROM (SELECT 'customer' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_name ILIKE '%#0000000_1%' UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%#0000000_1%' UNION ALL SELECT 'part', p_partkey, p_name FROM part WHERE p_name ILIKE '%#0000000_1%') ORDER BY kind, id LIMIT 50""")
def pin_search(spark, sf_dir):
    one = lambda t, i, n: read(spark, sf_dir, t).where(F.col(n).ilike("%#0000000_1%")).select(F.lit(t).alias("kind"), F.col(i).alias("id"), F.col(n).alias("name"))
    return one("customer", "c_custkey", "c_name").unionByName(one("supplier", "s_suppkey", "s_name")).unionByName(one("part", "p_partkey", "p_name")).orderBy("kind", "id").limit(50)


# --- source health ---

_JOBS = f"""jobs AS (SELECT l_suppkey || '-' || strftime(l_shipdate, '%Y-%m') AS job_id, l_suppkey AS connector_id, epoch_us(max(l_shipdate)) // 1000 AS completed_ms, epoch_us(min(l_shipdate)) // 1000 AS started_ms, count(*) AS fetched,
  count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_linestatus = 'F') AS deduplicated, CASE WHEN count(*) = 1 THEN 'failed' WHEN count(*) FILTER (l_returnflag = 'R') > 2 THEN 'partial' ELSE 'completed' END AS status FROM lineitem GROUP BY l_suppkey, strftime(l_shipdate, '%Y-%m')),
health AS (SELECT job_id, connector_id, completed_ms AS observed_ms, CASE status WHEN 'completed' THEN CASE WHEN failed > 0 THEN 'degraded' ELSE 'healthy' END WHEN 'partial' THEN 'degraded' ELSE 'failing' END AS health, completed_ms - started_ms AS latency_ms,
  round(failed / fetched, 6) AS error_rate, round(deduplicated / fetched, 6) AS duplicate_rate FROM jobs)"""


def _jobs(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").withColumn("ms", epoch_ms("l_shipdate")).withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    j = li.groupBy("l_suppkey", "month").agg(F.max("ms").alias("completed_ms"), F.min("ms").alias("started_ms"), F.count("*").alias("fetched"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count_if(F.col("l_linestatus") == "F").alias("deduplicated"))
    return j.select(F.concat_ws("-", F.col("l_suppkey").cast("string"), "month").alias("job_id"), F.col("l_suppkey").alias("connector_id"), "completed_ms", "started_ms", "fetched", "failed", "deduplicated", F.when(F.col("fetched") == 1, "failed").when(F.col("failed") > 2, "partial").otherwise("completed").alias("status"))


@query("source_health", f"WITH {_JOBS} SELECT * FROM health")
def source_health(spark, sf_dir):
    return health.job_health(_jobs(spark, sf_dir)).drop("freshness", "schema_state")


@query(
    "source_readiness",
    f"""WITH {_JOBS}, c AS (SELECT s_suppkey AS connector_id, s_suppkey % 9 <> 0 AS active FROM supplier UNION ALL SELECT 1000000, true), sc AS (SELECT connector_id, connector_id % 8 <> 0 AS schema_active FROM c),
h AS (SELECT * FROM health QUALIFY row_number() OVER (PARTITION BY connector_id ORDER BY observed_ms DESC, job_id DESC) = 1)
SELECT connector_id, job_id, CASE WHEN NOT active OR NOT schema_active THEN 'not_active' WHEN health IS NULL THEN 'unknown' WHEN health = 'failing' THEN 'blocked' WHEN health = 'healthy' AND connector_id % 2 = 0 THEN 'ready' ELSE 'degraded' END AS readiness
FROM c JOIN sc USING (connector_id) LEFT JOIN h USING (connector_id)""",
)
def source_readiness(spark, sf_dir):
    c = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("connector_id"), (F.col("s_suppkey") % 9 != 0).alias("active")).union(spark.range(1).select(F.lit(1000000), F.lit(True)))
    s = c.select("connector_id", (F.col("connector_id") % 8 != 0).alias("schema_active"))
    h = health.latest(health.job_health(_jobs(spark, sf_dir)), ["connector_id"], F.desc("observed_ms"), F.desc("job_id"))
    even = F.col("connector_id") % 2 == 0
    h = h.withColumn("freshness", F.when(even, "fresh").otherwise("unknown")).withColumn("schema_state", F.when(even, "stable").otherwise("unknown"))
    return health.readiness(c, h, s).select("connector_id", "job_id", "readiness")


@query("connector_status", f"""WITH {_JOBS}, n AS (SELECT max(completed_ms) AS now FROM jobs), w AS (SELECT connector_id, CAST(sum(fetched - failed) AS BIGINT) AS inserted FROM jobs, n WHERE completed_ms > now - {30 * DAY_MS} GROUP BY ALL)
SELECT s_suppkey AS connector_id, coalesce(inserted, 0) AS inserted FROM supplier LEFT JOIN w ON connector_id = s_suppkey""")
def connector_status(spark, sf_dir):
    j = _jobs(spark, sf_dir)
    now = j.agg(F.max("completed_ms").alias("now"))
    w = j.crossJoin(F.broadcast(now)).where(F.col("completed_ms") > F.col("now") - 30 * DAY_MS).groupBy("connector_id").agg(F.sum(F.col("fetched") - F.col("failed")).alias("inserted"))
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("connector_id")).join(w, "connector_id", "left").na.fill(0, ["inserted"])


# --- candidates over runs ---

_CANDS = f"""{OBS}, c AS (SELECT 'rule_' || (k % 4) AS rule_id, category AS signal_type, stream_id, jurisdiction_id, entity AS title, {sql_hash('"offset"')} AS candidate_hash, "offset" AS candidate_id, ts_ms AS seen_ms FROM obs),
keyed AS (SELECT *, {sql_hash('rule_id', 'signal_type', 'stream_id', 'jurisdiction_id', 'title')} AS semantic_key FROM c)"""


def _cands(spark, sf_dir):
    c = observations(spark, sf_dir).select(F.concat(F.lit("rule_"), (F.col("k") % 4).cast("string")).alias("rule_id"), F.col("category").alias("signal_type"), "stream_id", "jurisdiction_id", F.col("entity").alias("title"), joined_hash(F.col("offset")).alias("candidate_hash"), F.col("offset").alias("candidate_id"), F.col("ts_ms").alias("seen_ms"))
    return c.withColumn("semantic_key", currentness.semantic_key())


@query(
    "candidate_currentness",
    f"""WITH {_CANDS} SELECT semantic_key, candidate_id, lead(seen_ms) OVER w AS retired_ms, lead(seen_ms) OVER w IS NULL AS is_current, lag(candidate_id) OVER w AS supersedes FROM keyed WINDOW w AS (PARTITION BY semantic_key ORDER BY seen_ms, candidate_id)""",
)
def candidate_currentness(spark, sf_dir):
    return currentness.current(_cands(spark, sf_dir)).select("semantic_key", "candidate_id", "retired_ms", "is_current", "supersedes")


@query(
    "negative_currentness",
    f"""WITH {_CANDS}, cur AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY semantic_key ORDER BY seen_ms DESC, candidate_id DESC) = 1), run AS (SELECT * FROM keyed WHERE candidate_id % 3 <> 0 AND rule_id <> 'rule_3')
SELECT rule_id, candidate_hash, 'not_observed_in_complete_replay' AS reason, {sql_hash('candidate_hash', "'not_observed_in_complete_replay'")} AS retirement_hash FROM cur
WHERE candidate_hash NOT IN (SELECT candidate_hash FROM run) AND rule_id IN (SELECT rule_id FROM run)""",
)
def negative_currentness(spark, sf_dir):
    c = _cands(spark, sf_dir)
    run = c.where("candidate_id % 3 <> 0 and rule_id <> 'rule_3'")
    return currentness.retirements(currentness.current(c), run, complete=True).select("rule_id", "candidate_hash", "reason", "retirement_hash")


@query("candidate_replays", f"""WITH {_CANDS} SELECT count(*) AS found, count(*) FILTER (candidate_id % 3 = 0) AS replayed, count(*) FILTER (candidate_id % 3 <> 0) AS inserted FROM keyed""")
def candidate_replays(spark, sf_dir):
    c = _cands(spark, sf_dir)
    return currentness.replay_count(c.where("candidate_id % 3 = 0"), c)


@query(
    "record_versions",
    """WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus AS hash, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders), k AS (SELECT * FROM r WHERE p IS NULL OR p <> hash)
SELECT o_custkey, o_orderkey, hash, row_number() OVER w AS version, lead(o_orderkey) OVER w AS valid_until, lead(o_orderkey) OVER w IS NULL AS is_current FROM k WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""",
)
def record_versions(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("hash"))
    return currentness.versions(o, ["o_custkey"], "hash", ["o_orderkey"]).withColumn("version", F.col("version").cast("long"))


@query(
    "bridge_candidates",
    f"""WITH {OBS}, p AS (SELECT "offset" AS pattern_id, stream_id || '/' || entity AS dedup_key, confidence FROM obs WHERE confidence >= 0.7), sent AS (SELECT DISTINCT stream_id || '/' || entity AS dedup_key FROM obs WHERE "offset" % 40 = 0)
SELECT dedup_key, pattern_id, round(confidence, 9) AS confidence, CASE WHEN confidence >= 0.9 THEN 'critical' WHEN confidence >= 0.8 THEN 'high' ELSE 'medium' END AS severity FROM p WHERE dedup_key NOT IN (SELECT dedup_key FROM sent)
QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY confidence DESC, pattern_id) = 1""",
)
def bridge_candidates(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("dedup_key", F.concat_ws("/", "stream_id", "entity"))
    x = readmodels.bridge_rows(obs.select(F.col("offset").alias("pattern_id"), "dedup_key", "confidence"), obs.where(F.col("offset") % 40 == 0))
    return x.withColumn("confidence", F.round("confidence", 9))


@query(
    "bridge_drain",
    f"""WITH {OBS} SELECT "offset" AS id, city, confidence IS NULL AS no_confidence, CASE WHEN city IS NULL THEN 'missing_city' WHEN confidence IS NULL THEN 'missing_confidence' END AS reject FROM obs WHERE "offset" % 7 <> 0""",
)
def bridge_drain(spark, sf_dir):
    obs = observations(spark, sf_dir).select(F.col("offset").alias("id"), "city", "confidence")
    x = readmodels.drained(obs, obs.where("id % 7 = 0"), ["city", "confidence"])
    return x.select("id", "city", F.col("confidence").isNull().alias("no_confidence"), "reject")


# --- graphs ---

_MEMBERS = f"""{OBS}, mem AS (SELECT DISTINCT stream_id || '/' || (ts_ms // 3600000) AS signal_id, entity, stream_id, min(ts_ms) OVER (PARTITION BY stream_id, ts_ms // 3600000, entity) AS ts_ms FROM obs)"""


@query(
    "entity_relationships",
    f"""WITH {_MEMBERS}, d AS (SELECT entity, count(*) AS n FROM mem GROUP BY ALL),
p AS (SELECT a.entity AS a, b.entity AS b, count(*) AS shared, count(DISTINCT a.ts_ms // {DAY_MS}) AS buckets, count(DISTINCT a.stream_id) AS streams FROM mem a JOIN mem b ON a.signal_id = b.signal_id AND a.entity < b.entity GROUP BY ALL)
SELECT a, b, shared, round(shared / (x.n + y.n - shared), 9) AS jaccard, buckets, streams, round(0.5 * shared / (x.n + y.n - shared) + 0.3 / buckets + 0.2 * streams / shared, 9)::DOUBLE AS strength FROM p JOIN d x ON x.entity = a JOIN d y ON y.entity = b""",
)
def entity_relationships(spark, sf_dir):
    hour = F.floor(F.col("ts_ms") / 3_600_000)
    m = observations(spark, sf_dir).groupBy("stream_id", hour.alias("h"), "entity").agg(F.min("ts_ms").alias("ts_ms"))
    m = m.select(F.concat_ws("/", "stream_id", F.col("h").cast("string")).alias("signal_id"), F.col("entity").alias("entity_id"), "stream_id", "ts_ms")
    return graph.relationships(m, 0.5, 0.3, 0.2, DAY_MS)


def _ring(spark, sf_dir):
    """Nations but the last five in one ring, and those five in a ring of their own."""
    w = W.partitionBy((F.col("n_nationkey") < 20).alias("ring")).orderBy("n_nationkey")
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("node"))
    nxt = n.withColumn("dst", F.coalesce(F.lead("node").over(w), F.first("node").over(w)))
    return n.select("node"), nxt.select(F.col("node").alias("src"), "dst")


_RING = """ring AS (SELECT n_name AS src, coalesce(lead(n_name) OVER w, first_value(n_name) OVER w) AS dst FROM nation WINDOW w AS (PARTITION BY n_nationkey < 20 ORDER BY n_nationkey))"""


@query(
    "adjacency_hops",
    f"""WITH RECURSIVE {_RING}, e AS (SELECT src, dst FROM ring UNION SELECT dst, src FROM ring), walk AS (SELECT (SELECT min(n_name) FROM nation) AS node, 0 AS hops UNION SELECT e.dst, hops + 1 FROM walk JOIN e ON e.src = walk.node WHERE hops < 26)
SELECT n_name AS node, min(hops) AS hops FROM nation LEFT JOIN walk ON walk.node = n_name GROUP BY n_name""",
)
def adjacency_hops(spark, sf_dir):
    nodes, edges = _ring(spark, sf_dir)
    return graph.hops(edges, nodes.agg(F.min("node")).first()[0], nodes)


@query(
    "directed_hops",
    f"""WITH RECURSIVE {_RING}, walk AS (SELECT (SELECT min(n_name) FROM nation) AS node, 0 AS hops UNION SELECT e.dst, hops + 1 FROM walk JOIN ring e ON e.src = walk.node WHERE hops < 26)
SELECT n_name AS node, min(hops) AS hops FROM nation LEFT JOIN walk ON walk.node = n_name GROUP BY n_name""",
)
def directed_hops(spark, sf_dir):
    nodes, edges = _ring(spark, sf_dir)
    return graph.hops(edges, nodes.agg(F.min("node")).first()[0], nodes, directed=True)


@query(
    "registry_faults",
    """WITH n AS (SELECT n_nationkey AS k, 'N' || n_nationkey AS node, n_nationkey * 3.8 AS lat, CAST(n_nationkey AS DOUBLE) AS area FROM nation), reg AS (SELECT * FROM n UNION ALL SELECT * FROM n WHERE k = 1),
e AS (SELECT node AS src, 'N' || ((k + 1) % 25) AS dst FROM n)
SELECT 'duplicate' AS fault, node AS subject FROM reg GROUP BY node HAVING count(*) > 1 UNION ALL SELECT 'coordinate_range', node FROM reg WHERE lat NOT BETWEEN -90 AND 90 UNION ALL SELECT 'area_range', node FROM reg WHERE area <= 0
UNION ALL SELECT 'unknown_neighbour', dst FROM e WHERE dst NOT IN (SELECT node FROM reg) UNION ALL SELECT 'self', src FROM e WHERE src = dst
UNION ALL SELECT 'one_way', src || '>' || dst FROM e WHERE (dst, src) NOT IN (SELECT (src, dst) FROM e)""",
)
def registry_faults(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))
    reg = n.select("node", F.col("node").alias("name"), (F.col("n_nationkey") * 3.8).alias("lat"), F.lit(0.0).alias("lon"), F.col("n_nationkey").cast("double").alias("area"))
    reg = reg.union(reg.where("node = 'N1'"))
    edges = n.select(F.col("node").alias("src"), F.concat(F.lit("N"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("dst"))
    return graph.registry_faults(reg, edges)


@query(
    "version_lineage",
    """SELECT o_custkey AS document_id, o_orderkey AS version_key, row_number() OVER w AS place, lag(o_orderkey) OVER w AS predecessor, CASE WHEN row_number() OVER w > 1 THEN first_value(o_orderkey) OVER w END AS base FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderpriority, o_orderkey)""",
)
def version_lineage(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version_key"), F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("sequence"))
    return graph.version_edges(o).withColumn("place", F.col("place").cast("long"))


@query(
    "trait_binding",
    """WITH v AS (SELECT l_orderkey AS document_id, l_linenumber AS version_key, l_suppkey % 3 AS run_id, l_partkey % 5 AS h FROM lineitem), r AS (SELECT document_id, run_id, min(version_key) AS exact FROM v GROUP BY ALL HAVING count(*) = 1),
t AS (SELECT l_orderkey * 10 + l_linenumber AS trait_id, l_orderkey AS document_id, l_linenumber % 3 AS run_id, l_partkey % 5 AS h FROM lineitem),
f AS (SELECT trait_id, min(v.version_key) AS historical FROM t JOIN v USING (document_id, h) GROUP BY ALL HAVING count(DISTINCT v.version_key) = 1)
SELECT trait_id, document_id, coalesce(exact, historical) AS version_key, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN historical IS NOT NULL THEN 'historical' ELSE 'unresolved' END AS binding
FROM t LEFT JOIN r USING (document_id, run_id) LEFT JOIN f USING (trait_id)""",
)
def trait_binding(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    h = F.array(F.col("l_partkey") % 5).alias("hashes")
    v = li.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("version_key"), (F.col("l_suppkey") % 3).cast("int").alias("run_id"), h)
    t = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trait_id"), F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber") % 3).alias("run_id"), h)
    return readmodels.bind_traits(t, v)


@query(
    "stream_binding",
    """WITH s AS (SELECT 'st' || s_suppkey AS stream_id, s_nationkey AS jurisdiction_id, s_suppkey % 40 AS module FROM supplier), r AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 5 = 0 THEN 'st' || (c_custkey % 200) END AS want, CASE WHEN c_custkey % 3 = 0 THEN 'st' || (c_custkey % 150) END AS source_id, c_nationkey AS jurisdiction_id, c_custkey % 41 AS module FROM customer)
SELECT request_id, coalesce((SELECT stream_id FROM s WHERE stream_id = want), (SELECT stream_id FROM s WHERE stream_id = source_id), (SELECT min(stream_id) FROM s WHERE s.jurisdiction_id = r.jurisdiction_id AND s.module = r.module HAVING count(*) = 1),
  (SELECT min(stream_id) FROM s WHERE s.jurisdiction_id = r.jurisdiction_id HAVING count(*) = 1), (SELECT min(stream_id) FROM s WHERE s.module = r.module HAVING count(*) = 1)) AS stream_id FROM r""",
)
def stream_binding(spark, sf_dir):
    key = lambda c: F.concat(F.lit("st"), c.cast("string"))
    s = read(spark, sf_dir, "supplier").select(key(F.col("s_suppkey")).alias("stream_id"), F.col("s_nationkey").alias("jurisdiction_id"), (F.col("s_suppkey") % 40).alias("module"))
    c = F.col("c_custkey")
    r = read(spark, sf_dir, "customer").select(c.alias("request_id"), F.when(c % 5 == 0, key(c % 200)).alias("want"), F.when(c % 3 == 0, key(c % 150)).alias("source_id"), F.col("c_nationkey").alias("jurisdiction_id"), (c % 41).alias("module"))
    return readmodels.find_stream(r, s)


@query(
    "review_groups",
    f"""WITH {OBS} SELECT stream_id, jurisdiction_id, category, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, min(entity) AS example, {sql_hash('stream_id', 'jurisdiction_id', 'category')} AS review_key FROM obs WHERE confidence IS NULL GROUP BY stream_id, jurisdiction_id, category""",
)
def review_groups(spark, sf_dir):
    obs = observations(spark, sf_dir).withColumn("status", F.when(F.col("confidence").isNull(), "unresolved").otherwise("resolved")).withColumn("name", F.col("entity"))
    return readmodels.review_groups(obs, ["stream_id", "jurisdiction_id", "category"])


@query("actor_profiles", f"""WITH {OBS} SELECT entity, count(*) AS events, max(ts_ms) AS last_ms, arg_max("offset", (ts_ms, "offset")) AS last_offset FROM obs GROUP BY entity""")
def actor_profiles(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("events"), F.max("ts_ms").alias("last_ms"), F.max(F.struct("ts_ms", "offset"))["offset"].alias("last_offset"))


@query("temporal_fingerprint", f"""WITH {OBS} SELECT entity, count(DISTINCT ts_ms // {DAY_MS}) AS days, min(ts_ms) AS earliest_ms, max(ts_ms) AS latest_ms, string_agg(DISTINCT CAST(ts_ms // {DAY_MS} AS VARCHAR), ',' ORDER BY CAST(ts_ms // {DAY_MS} AS VARCHAR)) AS listed FROM obs GROUP BY entity""")
def temporal_fingerprint(spark, sf_dir):
    day = F.floor(F.col("ts_ms") / DAY_MS).cast("string")
    return observations(spark, sf_dir).groupBy("entity").agg(F.count_distinct(day).alias("days"), F.min("ts_ms").alias("earliest_ms"), F.max("ts_ms").alias("latest_ms"), F.array_join(F.array_sort(F.collect_set(day)), ",").alias("listed"))


@query("incremental_difference", """SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'""")
def incremental_difference(spark, sf_dir):
    returned = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey").distinct().join(returned, "o_orderkey", "left_anti")


# a key found again, a key with another hash, keys only here or only there
_MERGE = """ex AS (SELECT o_custkey AS semantic_key, 'h' || (o_orderkey % 3) AS candidate_hash, min(o_orderkey) AS first_ms, max(o_orderkey) AS seen_ms FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
existing AS (SELECT *, candidate_hash = max(candidate_hash) OVER (PARTITION BY semantic_key) AS is_current, 'r1' AS last_run FROM ex),
run AS (SELECT DISTINCT o_custkey AS semantic_key, 'h' || (o_orderkey % 4) AS candidate_hash FROM orders WHERE o_orderstatus = 'O'), newest AS (SELECT semantic_key, max(candidate_hash) AS new_hash FROM run GROUP BY ALL)"""


@query(
    "candidate_upsert",
    f"""WITH {_MERGE} SELECT semantic_key, candidate_hash, coalesce(e.first_ms, 9000000000) AS first_ms, CASE WHEN r.semantic_key IS NOT NULL THEN 9000000000 ELSE e.seen_ms END AS seen_ms,
  CASE WHEN new_hash IS NULL THEN e.is_current ELSE candidate_hash = new_hash END AS is_current, CASE WHEN r.semantic_key IS NOT NULL THEN 'r2' ELSE e.last_run END AS last_run
FROM existing e FULL JOIN run r USING (semantic_key, candidate_hash) LEFT JOIN newest n USING (semantic_key)""",
)
def candidate_upsert(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    hashed = lambda m: F.concat(F.lit("h"), (F.col("o_orderkey") % m).cast("string")).alias("candidate_hash")
    ex = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("semantic_key"), hashed(3)).agg(F.min("o_orderkey").alias("first_ms"), F.max("o_orderkey").alias("seen_ms"))
    ex = ex.withColumn("is_current", F.col("candidate_hash") == F.max("candidate_hash").over(W.partitionBy("semantic_key"))).withColumn("last_run", F.lit("r1"))
    run = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("semantic_key"), hashed(4))
    return currentness.merged(ex, run, "r2", 9_000_000_000)
