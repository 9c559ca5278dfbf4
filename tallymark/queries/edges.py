from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..tables import OBS, epoch_ms, observations, read

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


@query("source_record_keys", """SELECT o_orderkey, sha256(concat_ws('|', CASE WHEN o_orderkey % 3 <> 0 THEN 'x' || o_orderkey ELSE '' END, '', '', CASE WHEN o_orderkey % 2 = 0 THEN 'http://s/' || o_custkey ELSE '' END, 'http://p', CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END, '', '')) AS record_key FROM orders""")
def source_record_keys(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    payload = F.struct(F.when(k % 3 != 0, _text("x", k)).alias("external_id"), F.when(k % 2 == 0, _text("http://s/", c)).alias("source_url"), F.struct(F.when(k % 5 == 0, c).alias("id")).alias("raw"))
    event = F.to_json(F.struct(payload.alias("payload"), F.struct(F.lit("http://p").alias("source_url")).alias("provenance")))
    return read(spark, sf_dir, "orders").select("o_orderkey", checks.source_record_key(event).alias("record_key"))


@query("json_lists", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'a' || o_custkey || ',b' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN '' ELSE '1,x' END AS listed FROM orders""")
def json_lists(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 5 == 0, _text('["a', F.col("o_custkey"), '", "b"]')).when(k % 5 == 1, "[]").when(k % 5 == 2, '{"a": 1}').when(k % 5 == 4, '[1, null, "x"]')
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(checks.json_list(text), ",").alias("listed"))


@query("described_shares", f"""WITH {OBS}, c AS (SELECT stream_id, category, count(*) AS n FROM obs GROUP BY ALL), t AS (SELECT *, CAST(sum(n) OVER (PARTITION BY stream_id) AS BIGINT) AS total FROM c)
SELECT stream_id, category, category || ' holds ' || n || ' of ' || total || ' observations (' || printf('%.1f', round(100 * n / total, 1)) || '%, z=' || printf('%.2f', round(CAST(n / 7 AS DOUBLE), 2)) || ')' AS described FROM t""")
def described_shares(spark, sf_dir):
    from pyspark.sql import Window as W

    c = observations(spark, sf_dir).groupBy("stream_id", "category").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(W.partitionBy("stream_id")))
    return c.select("stream_id", "category", checks.concentration_text(F.col("category"), F.col("n"), F.col("total"), F.col("n") / 7).alias("described"))


@query(
    "joint_similarities",
    """WITH x AS (SELECT a.c_custkey AS a, b.s_suppkey AS b, a.c_custkey * 1000 AS t1, b.s_suppkey * 60000 AS t2, 40 + a.c_nationkey AS y1, -100 + a.c_nationkey AS x1, CASE WHEN b.s_suppkey % 4 <> 0 THEN 41.5 + b.s_nationkey END AS y2, -99.0 + b.s_nationkey AS x2 FROM customer a JOIN supplier b ON b.s_nationkey = a.c_nationkey),
s AS (SELECT *, least(greatest(1 - abs(t2 - t1) / 3600000.0::DOUBLE, 0), 1) AS t, 2 * 6371.0 * atan2(sqrt(h), sqrt(1 - h)) AS d FROM (SELECT *, pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2) AS h FROM x))
SELECT a, b, round(t, 6) AS temporal, round(exp(-(d * d) / (2 * 150.0 * 150.0)), 6) AS spatial, round(t * exp(-(d * d) / (2 * 150.0 * 150.0)), 6) AS joint FROM s""",
)
def joint_similarities(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") * 1000).alias("t1"), (40 + F.col("c_nationkey")).cast("double").alias("y1"), (-100 + F.col("c_nationkey")).cast("double").alias("x1"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") * 60000).alias("t2"), F.when(F.col("s_suppkey") % 4 != 0, 41.5 + F.col("s_nationkey")).alias("y2"), (-99.0 + F.col("s_nationkey")).alias("x2"))
    return checks.joint_similarities(a, b, "nation", 3_600_000, 150.0)


@query(
    "window_errors",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'missing_from' WHEN o_orderkey % 11 = 0 THEN 'missing_to' WHEN o_orderkey % 3 = 0 THEN 'from_exceeds_to' WHEN o_orderdate >= TIMESTAMP '2000-01-01' THEN 'to_exceeds_as_of' END AS error, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN -86400000::BIGINT ELSE 86400000 END END AS length_ms FROM orders""",
)
def window_errors(spark, sf_dir):
    k = F.col("o_orderkey")
    day = F.date_trunc("day", "o_orderdate")
    iso = lambda d: F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    start = F.when(k % 7 != 0, iso(day)).otherwise("soon")
    end = F.when(k % 11 != 0, F.when(k % 3 == 0, iso(day - F.expr("interval 1 day"))).otherwise(iso(day + F.expr("interval 1 day"))))
    return read(spark, sf_dir, "orders").select("o_orderkey", checks.window_error(start, end, F.lit("2000-01-01T12:00:00Z")).alias("error"), checks.window_length(start, end).alias("length_ms"))


_BODIES = {
    "ingest": [('{"source_id": "s", "jurisdiction_id": "j", "module_hint": "m", "signals": []}', ""), ('{"source_id": "", "jurisdiction_id": 3, "signals": {}}', "source_id,jurisdiction_id,module_hint,signals"), ("[]", "body,source_id,jurisdiction_id,module_hint,signals"), ("no json", "body,source_id,jurisdiction_id,module_hint,signals")],
    "cursor": [('{"name": "c"}', ""), ('{"name": "c", "from_offset": 5, "from_timestamp": "2024-01-01T00:00:00Z"}', ""), ('{"from_offset": "5", "from_timestamp": "soon"}', "name,from_offset,from_timestamp")],
    "investigation": [('{"trigger": {"stream_id": "s", "from_offset": 1, "to_offset": 1}}', ""), ('{"trigger": {"stream_id": "s", "from_offset": 2, "to_offset": 1}}', "order"), ('{"trigger": 1}', "trigger,stream_id,from_offset,to_offset"), ('{"trigger": {"from_offset": 1.5}}', "stream_id,from_offset,to_offset")],
}


@query("request_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{kind}', {i}, '{errors}')" for kind, cases in _BODIES.items() for i, (_, errors) in enumerate(cases)) + ") AS t(kind, place, errors)")
def request_errors(spark, sf_dir):
    out = None
    for kind, cases in _BODIES.items():
        one = spark.createDataFrame([(i, body) for i, (body, _) in enumerate(cases)], "place int, body string").select(F.lit(kind).alias("kind"), "place", checks.request_errors(F.col("body"), kind).alias("errors"))
        out = one if out is None else out.union(one)
    return out
