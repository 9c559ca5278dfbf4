from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import forms
from ..plans import domains, filters, lenses, modules
from ..sources import normalizers
from ..tables import DAY_MS, OBS, observations, read, sql_hash

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "filter_stack",
    f"""WITH {OBS}, f AS (SELECT *, {sql_hash('category', 'jurisdiction_id', f'ts_ms // {DAY_MS}')} AS fingerprint FROM obs WHERE stream_id IN ('click', 'purchase') AND category IN ('cat_7', 'cat_8', 'cat_9') AND confidence >= 0.2 AND ts_ms BETWEEN 1704153600000 AND 1705276800000),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY confidence DESC, "offset") = 1) SELECT "offset", stream_id, category, jurisdiction_id FROM d QUALIFY count(*) OVER (PARTITION BY jurisdiction_id, ts_ms // {3 * DAY_MS}) >= 2""",
)
def filter_stack(spark, sf_dir):
    """A stack of scopes, a threshold, deduplication and a convergence window, applied as one predicate
    and two keyed steps."""
    from ..functions.columns import time_bucket
    from ..tables import joined_hash

    stack = filters.resolve(
        requested=[{"filter_id": "source_scope", "parameters": {"source_ids": ["purchase", "click"]}}, {"filter_id": "signal_type_scope", "parameters": {"signal_types": ["cat_7", "cat_8", "cat_9"]}}, {"filter_id": "time_window_scope", "parameters": {"start": 1704153600000, "end": 1705276800000}}],
        module_required=[{"filter_id": "provenance_threshold", "parameters": {"minimum_confidence": 0.2}}, "deterministic_deduplication"],
        domain_required=[{"filter_id": "convergence_window", "parameters": {"minimum_signal_count": 2, "window_ms": 3 * DAY_MS}}],
    )
    obs = observations(spark, sf_dir).withColumn("fingerprint", joined_hash(F.col("category"), F.col("jurisdiction_id"), time_bucket(F.col("ts_ms"), DAY_MS)))
    return stack.apply(obs, {"source_ids": "stream_id", "signal_types": "category", "group": "jurisdiction_id"}).select("offset", "stream_id", "category", "jurisdiction_id")


@query(
    "lens_blend",
    """WITH a AS (SELECT c_custkey AS subject, unnest(['recurrence', 'amplification', 'disconfirmation']) AS lens, unnest([0.5, 0.3, 0.2]::DOUBLE[]) AS weight FROM customer),
x AS (SELECT *, CASE WHEN lens = 'recurrence' THEN (subject % 11) / 10.0 WHEN lens = 'amplification' THEN CASE WHEN subject % 7 <> 0 THEN (subject % 5) / 4.0 END ELSE CASE WHEN subject % 3 = 0 THEN 0.0 ELSE 0.25 END END AS s FROM a)
SELECT subject, count(s) AS resolved, count(*) FILTER (s IS NULL) AS unresolved, CASE WHEN count(*) FILTER (s IS NULL) = 0 THEN round(CAST(sum(weight * s) AS DOUBLE), 9) END AS score FROM x GROUP BY subject""",
)
def lens_blend(spark, sf_dir):
    key = F.col("c_custkey")
    one = lambda lens, status, score: F.struct(F.lit(lens).alias("lens"), status.alias("status"), score.cast("double").alias("score"), F.lit(1).alias("evidence"))
    seen = F.lit("observed")
    a = read(spark, sf_dir, "customer").select(key.alias("subject"), F.inline(F.array(
        one("recurrence", seen, (key % 11) / 10), one("amplification", F.when(key % 7 != 0, "observed").otherwise("unresolved"), F.when(key % 7 != 0, (key % 5) / 4)),
        one("disconfirmation", F.when(key % 3 == 0, "not_observed").otherwise("observed"), F.when(key % 3 != 0, F.lit(0.25))))))
    return lenses.blend(a, {"recurrence": 0.5, "amplification": 0.3, "disconfirmation": 0.2}).withColumn("score", F.round("score", 9))


@query(
    "geographic_similarity",
    """WITH n AS (SELECT n_nationkey AS id, n_regionkey, radians(n_nationkey * 3.0 - 40) AS la, radians(n_nationkey * 7.0 - 90) AS lo FROM nation),
d AS (SELECT a.id AS a, b.id AS b, pow(sin((b.la - a.la) / 2), 2) + cos(a.la) * cos(b.la) * pow(sin((b.lo - a.lo) / 2), 2) AS h FROM n a JOIN n b ON a.n_regionkey = b.n_regionkey AND a.id < b.id),
k AS (SELECT a, b, 6371.0 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS km FROM d)
SELECT a, b, round(km, 6) AS distance, round(exp(-km * km / (2 * 2000.0 * 2000.0)), 9) AS similarity FROM k""",
)
def geographic_similarity(spark, sf_dir):
    k = F.col("n_nationkey")
    n = read(spark, sf_dir, "nation").select(k.alias("id"), "n_regionkey", F.struct((k * 3.0 - 40).alias("lat"), (k * 7.0 - 90).alias("lon")).alias("x"))
    x = domains.pairwise(n, n, domains.DomainSpace("geographic", 2000.0), F.expr("l.n_regionkey = r.n_regionkey and l.id < r.id"))
    return x.select("a", "b", F.round("distance", 6).alias("distance"), F.round("similarity", 9).alias("similarity"))


@query(
    "vector_similarity",
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d FROM e a JOIN e b ON a.label = b.label AND b.vec_id = a.vec_id + 10)
SELECT a, b, round(d, 6) AS distance, round(exp(-d * d / 2), 9) AS similarity FROM p""",
)
def vector_similarity(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("x"))
    x = domains.pairwise(e, e, domains.DomainSpace("vector", 1.0, 64), F.expr("l.label = r.label and r.id = l.id + 10"))
    return x.select("a", "b", F.round("distance", 6).alias("distance"), F.round("similarity", 9).alias("similarity"))


@query(
    "module_bindings",
    """WITH b AS (SELECT 'm' || (c_custkey % 20) AS module_id, c_custkey AS connector_id, c_nationkey AS schema_id, 'k' || (c_custkey % 3) AS adapter_class, c_custkey % 4 <> 0 AS required FROM customer),
c AS (SELECT s_suppkey * 3 AS connector_id, 'k' || (s_suppkey % 4) AS adapter_class, s_nationkey AS schema_id, s_suppkey % 5 <> 0 AS active FROM supplier), s AS (SELECT n_nationkey AS schema_id, n_nationkey % 6 <> 0 AS active FROM nation WHERE n_nationkey < 20),
x AS (SELECT b.*, array_to_string(list_filter([CASE WHEN c.connector_id IS NOT NULL AND c.adapter_class <> b.adapter_class THEN 'adapter_class_mismatch' END, CASE WHEN NOT c.active THEN 'connector_inactive' END, CASE WHEN c.connector_id IS NULL THEN 'connector_not_found' END,
  CASE WHEN c.schema_id <> b.schema_id THEN 'connector_schema_mismatch' END, CASE WHEN NOT s.active THEN 'schema_inactive' END, CASE WHEN s.schema_id IS NULL THEN 'schema_not_found' END], lambda r: r IS NOT NULL), ',') AS reasons FROM b LEFT JOIN c USING (connector_id) LEFT JOIN s ON s.schema_id = b.schema_id)
SELECT module_id, connector_id, schema_id, adapter_class, required, CASE WHEN reasons = '' THEN 'ready' WHEN required THEN 'blocked' ELSE 'degraded' END AS state, reasons FROM x""",
)
def module_bindings(spark, sf_dir):
    k = F.col("c_custkey")
    b = read(spark, sf_dir, "customer").select(F.concat(F.lit("m"), (k % 20).cast("string")).alias("module_id"), k.alias("connector_id"), F.col("c_nationkey").alias("schema_id"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("adapter_class"), (k % 4 != 0).alias("required"))
    s = F.col("s_suppkey")
    c = read(spark, sf_dir, "supplier").select((s * 3).alias("connector_id"), F.concat(F.lit("k"), (s % 4).cast("string")).alias("adapter_class"), F.col("s_nationkey").alias("schema_id"), (s % 5 != 0).alias("active"))
    n = read(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("schema_id"), (F.col("n_nationkey") % 6 != 0).alias("active"))
    return modules.operational(b, c, n)


@query(
    "normalized_awards",
    """SELECT 'usa_spending' AS source, CASE WHEN o_totalprice * 4 > 1000000 THEN 'large_federal_contract' ELSE 'federal_contract_award' END AS signal_type, epoch_us(date_trunc('day', o_orderdate)) // 1000 AS ts_ms,
  CASE WHEN o_custkey % 5 = 0 THEN 'us_federal' ELSE 'us_state_S' || (o_custkey % 50) END AS region, 'us_federal' AS jurisdiction, 'usaspend_' || o_orderkey AS external_id FROM orders""",
)
def normalized_awards(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    state = F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit("S"), (F.col("o_custkey") % 50).cast("string")))
    raw = F.to_json(F.struct(F.col("o_orderkey").alias("award_id"), (F.col("o_totalprice") * 4).alias("total_obligation"), F.struct(F.struct(state.alias("state_code")).alias("location")).alias("recipient"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date")))
    return normalizers.normalize(o.select(raw.alias("raw")), "usa_spending").select("source", "signal_type", "ts_ms", "region", "jurisdiction", "external_id")


@query(
    "normalized_facilities",
    """WITH f AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS n FROM lineitem GROUP BY l_suppkey)
SELECT 'epa_' || l_suppkey AS external_id, CASE WHEN n > 3 THEN 'repeat_environmental_violator' ELSE 'environmental_violation' END AS signal_type, 'us_state_' || (l_suppkey % 50) AS region FROM f""",
)
def normalized_facilities(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).alias("n"))
    raw = F.to_json(F.struct(F.col("l_suppkey").alias("RegistryID"), F.col("n").alias("CWAVioCount"), (F.col("l_suppkey") % 50).cast("string").alias("FacState")))
    return normalizers.normalize(li.select(raw.alias("raw")), "epa_echo").select("external_id", "signal_type", "region")


def _letters(spark, sf_dir):
    """Letters written from orders by a template, as the tables hold no such text."""
    k, unit = F.col("o_orderkey"), F.element_at(F.array(*map(F.lit, ("days", "weeks", "business days", "months"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    part = lambda *cases: reduce(lambda w, c: w.when(c[0], c[1]), cases[1:], F.when(*cases[0])).otherwise("")
    body = F.concat(
        part((k % 3 == 0, "WAGE CLAIM FORM. ")), F.when(k % 9 == 5, "Reply no later than ").when(k % 9 == 6, "Your deadline is ").otherwise("You must file an appeal within "), (k % 60 + 1).cast("string"), F.lit(" "), unit, F.lit(" of the notice. "),
        F.when(k % 2 == 0, F.lit("The tenant faces eviction in California. ")).otherwise("Unpaid wages and overtime are a wage theft matter. "), F.when(k % 5 == 0, F.concat(F.lit("See https://forms.example.gov/a/"), k.cast("string"), F.lit("). "))).otherwise(""),
        part((k % 7 == 0, "Ask the EEOC. "), (k % 7 == 1, "Ask the Department of Labor or the FTC. "), (k % 7 == 2, "A claim form and a hearing request are enclosed, see federal law. ")),
        part((k % 11 == 0, "Come to 12 Main Street, Tacoma. "), (k % 11 == 1, "Phone 206-555-0100. ")))
    return read(spark, sf_dir, "orders").select(k.alias("letter"), body.alias("text"))


_LETTERS = """letters AS (SELECT o_orderkey AS letter, text, lower(text) AS low FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'WAGE CLAIM FORM. ' ELSE '' END || CASE o_orderkey % 9 WHEN 5 THEN 'Reply no later than ' WHEN 6 THEN 'Your deadline is ' ELSE 'You must file an appeal within ' END ||
  (o_orderkey % 60 + 1) || ' ' || ['days', 'weeks', 'business days', 'months'][o_orderkey % 4 + 1] || ' of the notice. ' || CASE WHEN o_orderkey % 2 = 0 THEN 'The tenant faces eviction in California. ' ELSE 'Unpaid wages and overtime are a wage theft matter. ' END ||
  CASE WHEN o_orderkey % 5 = 0 THEN 'See https://forms.example.gov/a/' || o_orderkey || '). ' ELSE '' END || CASE o_orderkey % 7 WHEN 0 THEN 'Ask the EEOC. ' WHEN 1 THEN 'Ask the Department of Labor or the FTC. ' WHEN 2 THEN 'A claim form and a hearing request are enclosed, see federal law. ' ELSE '' END ||
  CASE o_orderkey % 11 WHEN 0 THEN 'Come to 12 Main Street, Tacoma. ' WHEN 1 THEN 'Phone 206-555-0100. ' ELSE '' END AS text FROM orders))"""


def _q(s: str) -> str:
    return s.replace("'", "''")


def _sql_found(rows) -> str:
    """(condition, name, confidence) in SQL as a list of structs, surest first."""
    items = ", ".join(f"CASE WHEN {has} THEN {{'o': -({conf})::DOUBLE, 'i': {i}, 'v': '{name}', 'c': ({conf})::DOUBLE}} END" for i, (has, name, conf) in enumerate(rows))
    return f"list_sort(list_filter([{items}], lambda x: x IS NOT NULL))"


def _sql_words(lists, base, step, most) -> str:
    count = lambda words: "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(low, w)))"
    return _sql_found([(f"{count(words)} > 0", name, f"least({most}, {base} + {step} * {count(words)})") for name, words in lists.items()])


def _sql_workflows() -> str:
    fits = lambda g: " AND ".join(f"contains(low, '{w}')" for w in g)
    sure = lambda groups: "CASE " + " ".join(f"WHEN {fits(g)} THEN least(0.95, 0.65 + 0.1 * {len(g)})" for g in groups) + " END"
    own = [(f"{sure(g)} IS NOT NULL", name, sure(g)) for name, g in forms.WORKFLOWS.items()]
    return _sql_found(own + [(f"{has} AND contains(low, 'california')", f"ca_{name}", f"least({conf} + 0.02, 0.97)") for has, name, conf in own])


_RECORDS = f"""{_LETTERS}, found AS (SELECT *, coalesce({', '.join(f"nullif(regexp_extract(text, '(?i){_q(p)}', 0), '')" for p, _ in forms.DEADLINES)}) AS d,
  nullif(regexp_replace(regexp_extract(text, '(?i){_q(forms.URL)}', 0), '[).,;:]+$', ''), '') AS url, trim(regexp_replace(coalesce({', '.join(f"nullif(regexp_extract(text, '{_q(p)}', 1), '')" for p in forms.NAMES)}), '\\s+', ' ', 'g')) AS form_name,
  {_sql_workflows()} AS workflows, {_sql_found([(' OR '.join([f"regexp_matches(text, '(?i)\\b{w}\\b')" for w in a[1]] + [f"contains(low, '{w.lower()}')" for w in a[2]]), name, '0.9') for name, a in forms.AGENCIES.items()])} AS agencies,
  {_sql_words(forms.DOMAINS, 0.35, 0.15, 0.95)} AS domains, {_sql_words(forms.STAGES, 0.45, 0.15, 0.9)} AS stages,
  {_sql_found([(f"{' OR '.join(f'regexp_matches(text, {chr(39)}{_q(p)}{chr(39)})' for p, _ in ps)}", name, f"least(0.95, 0.5 + 0.2 * ({' + '.join(f'regexp_matches(text, {chr(39)}{_q(p)}{chr(39)})::INT' for p, _ in ps)}))") for name, ps in forms.JURISDICTIONS.items()])} AS jurisdictions,
  CASE WHEN regexp_matches(low, 'https?://|www\\.|\\.(?:gov|org|com|edu|net|us)\\b') THEN 'online' WHEN regexp_matches(text, '{forms.PHONE}') THEN 'phone' WHEN regexp_matches(text, '(?i){_q(forms.STREET)}') THEN 'mail_or_in_person' ELSE 'unknown' END AS method FROM letters),
dated AS (SELECT *, CAST(regexp_extract(d, '(\\d+)\\s', 1) AS INT) AS value, lower(regexp_extract(d, '(business\\s+days?|days?|weeks?|months?|years?)$', 1)) AS unit FROM found),
scored AS (SELECT *, CAST(value * CASE WHEN contains(unit, 'day') THEN 1 WHEN unit LIKE 'week%' THEN 7 WHEN unit LIKE 'month%' THEN 30 ELSE 365 END AS INT) AS days,
  ((url IS NOT NULL)::INT + (len(workflows) > 0)::INT + (len(agencies) > 0)::INT + (len(domains) > 0)::INT + (form_name IS NOT NULL)::INT + 0.5 * (d IS NOT NULL)::INT + 0.5 * (len(stages) > 0)::INT)::DOUBLE AS confidence FROM dated),
flagged AS (SELECT *, CASE WHEN confidence >= 4 AND url IS NOT NULL AND len(agencies) > 0 THEN 'pending_live_verification' WHEN confidence >= 2 THEN 'pending_review' ELSE 'pending_enrichment' END AS status,
  array_to_string(list_filter([CASE WHEN url IS NULL THEN 'missing_url' END, CASE WHEN len(agencies) = 0 THEN 'missing_agency' END, CASE WHEN len(workflows) = 0 THEN 'missing_workflow' END, CASE WHEN len(domains) = 0 THEN 'missing_domain' END, CASE WHEN confidence < 2 THEN 'low_confidence' END,
    CASE WHEN len(domains) > 1 THEN 'multiple_domains' END, CASE WHEN len(workflows) > 1 THEN 'multiple_workflows' END, CASE WHEN len(agencies) > 1 THEN 'multiple_agencies' END, CASE WHEN days IS NOT NULL THEN 'has_deadline' END, CASE WHEN NOT contains(unit, 'day') THEN 'deadline_unit_not_days' END,
    CASE WHEN len(jurisdictions) > 1 THEN 'ambiguous_jurisdiction' END, CASE WHEN url IS NOT NULL THEN 'requires_live_url_verification' END], lambda x: x IS NOT NULL), ',') AS flags FROM scored)"""
_SQL_TEXT = lambda c: f"array_to_string(list_transform({c}, lambda x: x.v || ':' || printf('%.2f', x.c)), ',') AS {c}"


def _text(c: str):
    return F.array_join(F.transform(c, lambda x: F.concat(x["value"], F.lit(":"), F.format_string("%.2f", x["confidence"]))), ",").alias(c)


_LISTS = ("workflows", "agencies", "domains", "stages", "jurisdictions")


@query("form_deadlines", f"WITH {_RECORDS} SELECT letter, d AS text, value, unit, days, CAST(CASE WHEN contains(unit, 'business') THEN 0.75 ELSE 0.85 END AS DOUBLE) AS confidence FROM scored")
def form_deadlines(spark, sf_dir):
    return _letters(spark, sf_dir).select("letter", forms.deadline(F.col("text")).alias("d")).select("letter", "d.*")


@query("form_records", f"WITH {_RECORDS} SELECT letter, url, form_name, {', '.join(map(_SQL_TEXT, _LISTS))}, confidence, status, method, flags FROM flagged")
def form_records(spark, sf_dir):
    x = forms.forms(_letters(spark, sf_dir), "letter", "text")
    return x.select("letter", "url", "form_name", *map(_text, _LISTS), "confidence", "status", "method", "flags")


_SPOT_WORDS = [(kind, w) for kind, words in (("action_keyword", forms.ACTIONS), ("form_indicator", forms.INDICATORS)) for w in words]


@query(
    "form_match_spots",
    f"""WITH {_LETTERS}, p AS (SELECT unnest([{', '.join(f"{{'kind': '{k}', 'p': '(?i)\\b{w}\\b', 'w': '{w}'}}" for k, w in _SPOT_WORDS)}, {', '.join(f"{{'kind': 'url', 'p': '(?i){_q(u)}', 'w': NULL}}" for u in forms.URLS)}, {{'kind': 'phone', 'p': '{forms.PHONE}', 'w': NULL}},
  {{'kind': 'address', 'p': '(?i){_q(forms.STREET)}[^.\n]*', 'w': NULL}}, {', '.join(f"{{'kind': 'deadline', 'p': '(?i){_q(d)}', 'w': NULL}}" for d, _ in forms.DEADLINES)}], recursive := true)),
m AS (SELECT letter, kind, w, regexp_extract_all(text, p.p) AS found, string_split_regex(text, p.p) AS gaps FROM letters, p WHERE regexp_matches(text, p.p)),
s AS (SELECT letter, kind, w, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM m),
d AS (SELECT DISTINCT letter, kind, coalesce(w, trim(found[i])) AS value, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start FROM s)
SELECT letter, kind, value, CAST(start AS INT) AS start, CAST(start + length(value) AS INT) AS "end" FROM d""",
)
def form_match_spots(spark, sf_dir):
    return _letters(spark, sf_dir).select("letter", F.inline(forms.scan(F.col("text"))))


@query(
    "context_windows",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 3000 AS a0 FROM lineitem), x AS (SELECT l_orderkey, greatest(a0 - 500, 0) AS a, least(a0 + 10 + 500, 3000) AS b FROM s),
p AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR before < a THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM p)
SELECT l_orderkey, min(a) AS start, max(b) AS "end", count(*) AS n FROM i GROUP BY l_orderkey, g""",
)
def context_windows(spark, sf_dir):
    s = F.col("l_partkey") % 3000
    x = read(spark, sf_dir, "lineitem").select("l_orderkey", s.alias("start"), (s + 10).alias("end"), F.lit(3000).cast("long").alias("length"))
    return forms.windows(x, "l_orderkey")


_GAPS_SQL = f"""WITH {_RECORDS}, e AS (SELECT *, unnest(list_transform(workflows, lambda x: x.v)) AS workflow, list_transform(stages, lambda x: x.v) AS st FROM flagged),
g AS (SELECT workflow, count(*) AS n, bool_or(list_contains(st, 'intake') OR len(domains) > 0) AS a, bool_or(list_contains(st, 'appeal') OR contains(lower(form_name), 'appeal')) AS b,
  bool_or(list_contains(st, 'hearing') OR list_contains(st, 'escalation') OR regexp_matches(lower(coalesce(form_name, '')), 'hearing|grievance|ombudsman')) AS c, bool_or(days IS NOT NULL) AS d, bool_or(url IS NOT NULL) AS u FROM e GROUP BY workflow),
w AS (SELECT unnest([{', '.join(f"'{x}'" for x in [*forms.WORKFLOWS, *(f'ca_{w}' for w in forms.WORKFLOWS)])}]) AS workflow)
SELECT workflow, coalesce(n, 0) AS n, array_to_string(list_filter([{', '.join(f"CASE WHEN NOT coalesce({c}, false) THEN '{g}' END" for c, g in zip('abcdu', forms.GAPS))}], lambda x: x IS NOT NULL), ',') AS gaps FROM w LEFT JOIN g USING (workflow)"""


@query("form_coverage", _GAPS_SQL)
def form_coverage(spark, sf_dir):
    return forms.coverage(forms.forms(_letters(spark, sf_dir), "letter", "text"))


@query(
    "form_statistics",
    f"""WITH {_RECORDS}, l AS (SELECT 'domain' AS "group", unnest(list_transform(domains, lambda x: x.v)) AS name FROM flagged UNION ALL SELECT 'workflow', unnest(list_transform(workflows, lambda x: x.v)) FROM flagged
  UNION ALL SELECT 'jurisdiction', unnest(list_transform(jurisdictions, lambda x: x.v)) FROM flagged UNION ALL SELECT 'status', status FROM flagged)
SELECT "group", name, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT 'total', 'forms', count(*) FROM flagged UNION ALL SELECT 'total', 'high_confidence', count(*) FROM flagged WHERE confidence >= 2
UNION ALL SELECT 'total', 'mean_confidence_milli', CAST(round(avg(confidence) * 1000) AS BIGINT) FROM flagged""",
)
def form_statistics(spark, sf_dir):
    return forms.statistics(forms.forms(_letters(spark, sf_dir), "letter", "text"))


def _staged(spark, sf_dir, table):
    return forms.staging(forms.extracted(_letters(spark, sf_dir), "letter", "text"), "letter", "run")[table]


_ENTITY = "CASE agencies[1].v " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in forms.AGENCIES.items()) + " END"


@query(
    "form_staging",
    f"""WITH {_RECORDS} SELECT letter, form_name, lower(regexp_replace(form_name, '[^A-Za-z0-9]+', '_', 'g')) AS form_key, url, method, agencies[1].v AS agency, {_ENTITY} AS agency_entity, jurisdictions[1].v AS jurisdiction, domains[1].v AS primary_domain, workflows[1].v AS primary_workflow,
  stages[1].v AS primary_stage, days AS deadline_days, unit AS deadline_unit, confidence, status, flags, sha256(text) AS source_hash, text[1:500].trim() AS excerpt FROM flagged""",
)
def form_staging(spark, sf_dir):
    return _staged(spark, sf_dir, "forms").drop("form_id", "run_id", "strategy", "normalized_url", "context_hash")


@query("form_staging_agencies", f"""WITH {_RECORDS} SELECT letter, unnest(list_transform(agencies, lambda x: x.v)) AS agency, 0.9::DOUBLE AS confidence FROM flagged""")
def form_staging_agencies(spark, sf_dir):
    return _staged(spark, sf_dir, "agencies").select("letter", "agency", "confidence")


@query("form_staging_workflows", f"""WITH {_RECORDS}, u AS (SELECT letter, unnest(workflows) AS w FROM flagged) SELECT letter, w.v AS workflow, round(w.c, 6) AS confidence, starts_with(w.v, 'ca_') AS of_state, regexp_replace(w.v, '^ca_', '') AS base_workflow FROM u""")
def form_staging_workflows(spark, sf_dir):
    return _staged(spark, sf_dir, "workflows").select("letter", "workflow", F.round("confidence", 6).alias("confidence"), "of_state", "base_workflow")


@query("form_staging_deadlines", f"""WITH {_RECORDS} SELECT letter, d AS text, value, unit, days, CAST(CASE WHEN contains(unit, 'business') THEN 0.75 ELSE 0.85 END AS DOUBLE) AS confidence, true AS requires_legal_verification FROM flagged WHERE days IS NOT NULL""")
def form_staging_deadlines(spark, sf_dir):
    return _staged(spark, sf_dir, "deadlines").drop("form_id")


@query("form_staging_provenance", f"""WITH {_LETTERS} SELECT letter, 'run' AS run_id, sha256(text) AS source_hash, 0 AS start, CAST(length(text) AS INT) AS "end", '{forms.ENGINE}' AS engine, true AS deterministic FROM letters""")
def form_staging_provenance(spark, sf_dir):
    return _staged(spark, sf_dir, "provenance").drop("form_id", "context_hash")


@query(
    "form_review_queue",
    f"""WITH {_RECORDS} SELECT letter, status, flags, confidence, CASE WHEN days <= 30 THEN 'high' WHEN confidence >= 4 AND url IS NOT NULL THEN 'medium' WHEN contains(flags, 'missing_workflow') OR contains(flags, 'missing_agency') THEN 'medium' ELSE 'low' END AS priority, replace(flags, ',', ', ') AS reason FROM flagged WHERE flags <> ''""",
)
def form_review_queue(spark, sf_dir):
    return _staged(spark, sf_dir, "reviews").drop("form_id")


@query(
    "form_text_sources",
    """SELECT 'documents' AS source, CAST(doc_id AS VARCHAR) AS id, length(text) AS n FROM documents WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), length(html) FROM pages WHERE trim(regexp_replace(html, '\\s+', ' ', 'g')) <> ''
UNION ALL SELECT 'conversations', conv_id || '-' || turn, length(text) FROM conversations WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''""",
)
def form_text_sources(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    x = forms.text_sources({"documents": (read(spark, sf_dir, "documents"), "doc_id", "text"), "pages": (read(spark, sf_dir, "pages"), "page_id", "html"), "conversations": (c, "id", "text")})
    return x.select("source", "id", F.length("text").cast("long").alias("n"))


@query(
    "backfilled_forms",
    f"""WITH c AS (SELECT conv_id || '-' || turn AS id, text, lower(text) AS low FROM conversations WHERE trim(text) <> ''), x AS (SELECT id, len(list_filter([{', '.join(f"'{w}'" for w in forms.DOMAINS['legal'])}], lambda w: contains(low, w))) AS n FROM c)
SELECT id, n > 0 AS legal FROM x""",
)
def backfilled_forms(spark, sf_dir):
    """Form records of whole texts of a source, without the blocks of context."""
    c = read(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    x = forms.forms(forms.text_sources({"conversations": (c, "id", "text")}), "id", "text")
    return x.select("id", F.exists("domains", lambda d: d["value"] == "legal").alias("legal"))
