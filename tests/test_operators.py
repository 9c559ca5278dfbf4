"""Operators on small fixtures whose results are worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tallymark.functions import checks
from tallymark.functions import columns as c
from tallymark.operators import convergence, currentness, entities, forms, graph, health, identity, integrity, ledgers, population, readmodels
from tallymark.queries import edges
from tallymark.registry import QUERIES
from tallymark.tables import DAY_MS


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def t(s):
    return F.lit(s).cast("string")


@pytest.mark.parametrize(
    "make, want",
    [
        (lambda: c.squeezed(t(" a \n b ")), "a b"),
        (lambda: c.squeezed(t("  ")), None),
        (lambda: c.comparable(t(" A  b")), "a b"),
        (lambda: c.first_text(t(None), t(" "), t("x ")), "x"),
        (lambda: c.stable_id(t("ab:1/x")), "ab:1/x"),
        (lambda: c.stable_id(t("-bad")), None),
        (lambda: c.text_list(t("b; a,b|  ")), ["a", "b"]),
        (lambda: c.entity_key(t("St. Mary's, Inc")), "STMARYSINC"),
        (lambda: c.identifier_key(t("ein"), t("12-3456789")), "123456789"),
        (lambda: c.identifier_key(t("ein"), t("12")), None),
        (lambda: c.identifier_key(t("cik"), t("320193")), "0000320193"),
        (lambda: c.identifier_kind(t("SEC_EDGAR")), "cik"),
        (lambda: c.award_recipient(t("Contract: ACME - North — $5")), "ACME - North"),
        (lambda: c.award_recipient(t("Grant: ACME – roads")), "ACME"),
        (lambda: c.state_alias(t("us_wa ")), "WA"),
        (lambda: c.web_address(t("Example.ORG/a/b/#top).")), "https://example.org/a/b"),
        (lambda: c.base64url(t("a?>~")), "YT8-fg"),
        (lambda: c.half_up(F.lit(-2.5), 0), -2.0),
        (lambda: c.bounded_rate(F.lit(3), F.lit(0)), None),
        (lambda: c.severity_by_confidence(F.lit(0.85)), "high"),
        (lambda: c.recency(100, F.lit(50), 100), 0.5),
        (lambda: c.euclidean(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))), 5.0),
    ],
)
def test_functions(spark, make, want):
    assert one(spark, make()) == want


def test_distance_and_similarity(spark):
    d = one(spark, c.haversine_km(F.lit(47.6062), F.lit(-122.3321), F.lit(45.5152), F.lit(-122.6784)))
    assert abs(d - 233.9) < 1
    assert one(spark, c.gaussian(F.lit(2.0), 2.0)) == pytest.approx(math.exp(-0.5))
    assert one(spark, c.gaussian(F.lit(None).cast("double"), 2.0)) is None
    with pytest.raises(ValueError):
        c.gaussian(F.lit(1.0), 0)


def test_trend_of_two_years(spark):
    rows = spark.createDataFrame([("s", 2020, 20), ("s", 2021, 50), ("s", 2023, 200), ("t", 2020, 9), ("t", 2021, 90)], "k string, y int, n long")
    got = population.trends(rows, ["k"], "y", "n").collect()
    assert [(r.k, r.year, r.prior_count, r.current_count, r.percent_change, r.severity) for r in got] == [("s", 2021, 20, 50, 150.0, "high")]
    assert got[0].confidence == 0.85


def test_spike_of_one_category(spark):
    rows = [("s", "WA", "big")] * 40 + [("s", "WA", f"small{i}") for i in range(8)] + [("s", "OR", "only")] * 30
    got = population.concentration(spark.createDataFrame(rows, "stream_id string, jurisdiction_id string, category string"), "frequency_spike", "category").collect()
    assert [(r.subject, r.n, r.total) for r in got] == [("big", 40, 48)] and got[0].z_score >= 1.5


def test_poisson_of_two_areas(spark):
    reg = spark.createDataFrame([("OR", 254799.0), ("WA", 184827.0), ("XX", 1.0)], "geography string, area double").where("geography <> 'XX'")
    s = [(i, "WA" if i < 3 else "OR", "a" if i % 2 else "b", 90, 0.8, f"f{i}") for i in range(10)]
    signals = spark.createDataFrame(s, "id long, geography string, signal_type string, ts_ms long, confidence double, fingerprint string")
    got = {r.geography: r for r in convergence.convergence(signals, reg, 100, 100).collect()}
    assert abs(got["WA"].expected - 4.204) < 1e-3 and abs(got["WA"].z_score + 0.587) < 1e-3
    assert got["WA"].score == pytest.approx(2 * 0.8 * math.log(4) * (0.5 + 0.5 * 0.9))
    empty = convergence.convergence(signals.limit(0), reg, 100, 100).collect()
    assert {(r.status, r.z_score, r.score) for r in empty} == {("below_threshold", None, None)}


def test_deduplication_keeps_the_surest(spark):
    s = spark.createDataFrame([("a", 0.8, "f"), ("b", 0.9, "f"), ("c", 0.9, "f"), ("d", None, "g"), ("e", None, "g")], "id string, confidence double, fingerprint string")
    assert sorted(r.id for r in convergence.deduplicated(s).collect()) == ["b", "d"]


def test_results_do_not_depend_on_partitions(spark):
    s = spark.createDataFrame([(i, f"h{i:064d}") for i in range(50)], "stream_id long, identity_hash string")
    assert convergence.population_hash(s.repartition(7), ["stream_id"], "identity_hash") == convergence.population_hash(s.coalesce(1).orderBy(F.desc("stream_id")), ["stream_id"], "identity_hash")


def test_append_is_replay_safe(spark):
    cols = "stream_id string, identity_hash string, offset long, ts_ms long, ingested_ms long"
    batch = spark.createDataFrame([("s", "a", 1, 1, 1), ("s", "a", 2, 1, 2), ("s", "b", 3, 1, 3), ("s", "k", 4, 1, 4), ("t", "a", 5, 1, 5), (None, "z", 6, 1, 6), ("s", None, 7, 1, 7)], cols)
    known = spark.createDataFrame([("s", "k", 9)], "stream_id string, identity_hash string, canonical_offset long")
    new, replays = identity.append_batch(batch, known)
    assert sorted((r.stream_id, r.identity_hash, r.new_offset) for r in new.collect()) == [("s", "a", 10), ("s", "b", 11), ("t", "a", 0)]
    assert sorted((r.identity_hash, r.replays) for r in replays.collect()) == [("a", 1), ("k", 1)]
    got = {r.stream_id: r for r in identity.receipts(batch, new, replays).collect()}
    assert (got["s"].received, got["s"].inserted, got["s"].replayed, got["s"].failed, got["s"].status) == (5, 2, 2, 1, "partial")
    assert got["t"].status == "completed"


def test_resolution_ladder(spark):
    e = spark.createDataFrame(
        [("e1", "nonprofit", "Alpha Fund", ["Alpha"], {"ein": "12-3456789"}, True), ("e2", "company", "Beta", [], {}, True), ("e3", "company", "Beta", [], {"ein": "987654321"}, True), ("e4", "person", "Gamma", [], {}, True), ("e5", "company", "Gone", [], {}, False)],
        "entity_id string, entity_type string, name string, variants array<string>, ids map<string,string>, active boolean",
    )
    a = spark.createDataFrame([("e1", "AF", "acronym", 1.0), ("e1", "Alfa", "fuzzy_match", 1.0), ("e1", "Alph", "spelling_variant", 0.9)], "entity_id string, alias string, alias_type string, confidence double")
    rows = [
        (1, "nonprofit", "unlike", "ein", "123456789", "resolved", "exact_external_identifier", "e1"), (2, "organization", "alpha FUND", None, None, "resolved", "exact_primary_name", "e1"), (3, "any", "alpha", None, None, "resolved", "exact_name_variant", "e1"),
        (4, "any", "A.F.", None, None, "resolved", "exact_alias", "e1"), (5, "any", "Alfa", None, None, "unresolved", "no_exact_match", None), (6, "any", "Alph", None, None, "unresolved", "no_exact_match", None),
        (7, "any", "Beta", None, None, "ambiguous", "duplicate_exact_name", None), (8, "any", "Alpha Fund", "ein", "987654321", "ambiguous", "identifier_name_conflict", None), (9, "organization", "Gamma", None, None, "unresolved", "exact_match_entity_type_mismatch", None),
        (10, "any", "Gone", None, None, "unresolved", "no_exact_match", None), (11, "any", "...", "ein", "1", "unresolved", "no_usable_identity_value", None), (12, "any", None, "canonical", "e2", "resolved", "exact_canonical_entity_id", "e2"), (13, "any", "Alpha Fund", "ein", "bad", "resolved", "exact_primary_name", "e1"),
    ]
    got = {r.candidate_id: r for r in entities.resolve(spark.createDataFrame([r[:5] for r in rows], "candidate_id long, expected_type string, name string, id_kind string, id_value string"), e, a).collect()}
    for r in rows:
        assert (got[r[0]].status, got[r[0]].method, got[r[0]].entity_id) == r[5:], r


def test_integrity_detectors(spark):
    day = DAY_MS
    e = spark.createDataFrame([("old", "Dissolved", 0, 10 * day), ("new", "active", 100 * day, None), ("late", "active", 900 * day, None)], "entity_id string, status string, formed_ms long, ended_ms long")
    ids = spark.createDataFrame([(x, k, "v") for x in ("old", "new", "late") for k in ("address", "phone")] + [("new", "tax", "1")], "entity_id string, kind string, value string")
    got = integrity.phoenix(e, ids).collect()
    assert [(r.predecessor, r.successor, r.gap_days, r.shared, r.confidence) for r in got] == [("old", "new", 90, 2, 1.0)]
    assert {(r.kind, r.entities) for r in integrity.identifier_reuse(ids).collect()} == {("address", 3), ("phone", 3)}
    tr = spark.createDataFrame([(1, "a", "m", 100.0, 0), (2, "m", "b", 95.0, 30 * day), (3, "m", "b", 95.0, 31 * day), (4, "m", "a", 95.0, day), (5, "m", "c", 70.0, day), (6, "m", "d", 105.0, 0)], "transfer_id long, from_id string, to_id string, amount double, ts_ms long")
    assert sorted((r.in_id, r.out_id, r.gap_days) for r in integrity.conduits(tr).collect()) == [(1, 2, 30), (1, 6, 0)]
    claims = spark.createDataFrame([("s", "p", " Yes", "x"), ("s", "p", "yes", "y"), ("s", "q", "1", "x"), ("s", "q", "2", "y"), ("s", "r", "1", "x"), ("s", "r", "2", "x")], "subject string, predicate string, value string, source string")
    assert [(r.subject, r.predicate) for r in integrity.contradictions(claims).collect()] == [("s", "q")]
    n = spark.createDataFrame([(5.0, None, 4.0), (5.0, 6.0, None), (5.0, 4.0, 6.0), (5.0, None, None)], "actual double, least double, most double")
    assert [r.side for r in integrity.out_of_range(n).collect()] == ["above", "below"]


def written(spark):
    """Records that stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()))


@pytest.mark.parametrize("many", [0, 3, 256])
def test_phoenix_pairs_equal_brute_force(spark, many):
    day, n = 86_400_000, 60
    ents = [(f"e{i}", "Dissolved" if i % 3 == 0 else "active", (i * 7 % 50) * day, (i * 11 % 40) * day if i % 3 == 0 else None) for i in range(n)]
    ids = [(f"e{i}", k, str(i * f % m)) for i in range(n) for k, f, m in (("a", 1, 3), ("b", 1, 5), ("c", 1, 2), ("d", 7, 30))] + [("e1", "a", "1"), ("e2", "d", None), ("e3", None, "x"), ("e6", None, "x")]
    held = {e: {(k, v) for x, k, v in ids if x == e and k is not None and v is not None} for e, *_ in ents}
    spark_ents = spark.createDataFrame(ents, "entity_id string, status string, formed_ms long, ended_ms long")
    spark_ids = spark.createDataFrame(ids, "entity_id string, kind string, value string")
    for shared in (1, 2, 3):
        want = {(a, b, (fb - ea) // day, len(held[a] & held[b])) for a, _, _, ea in ents if ea is not None for b, _, fb, _ in ents if a != b and fb >= ea and len(held[a] & held[b]) >= shared}
        got = [(r.predecessor, r.successor, r.gap_days, r.shared) for r in integrity.phoenix(spark_ents, spark_ids, shared=shared, many=many).collect()]
        assert want and len(got) == len(want) and set(got) == want


def test_one_wide_identifier_brings_no_pairs_together(spark):
    e = spark.range(2000).selectExpr("concat('e', id) as entity_id", "if(id % 2 = 0, 'dissolved', 'active') as status", "1000L as formed_ms", "if(id % 2 = 0, 0L, null) as ended_ms")
    ids = spark.range(2000).selectExpr("concat('e', id) as entity_id", "inline(array(named_struct('kind', 'agent', 'value', 'all'), named_struct('kind', 'phone', 'value', string(id div 2))))")
    before = written(spark)
    assert integrity.phoenix(e, ids).count() == 1000  # each with the one of its telephone; a million pairs share the agent
    assert written(spark) - before < 100_000


def test_traits_become_text_once_a_run(spark, sf):
    """Texts of runs are made below the join with versions, and are equal to those of the arrays."""
    plan = QUERIES["traits_of_versions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join LeftOuter") < plan.index("array_join")
    v = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, None)], "version_key long, run_id long")
    t = spark.createDataFrame([(12, 7), (9, 7), (5, 6), (4, None), (9, 7)], "trait_id long, run_id long")
    assert {r.version_key: r.traits for r in ledgers.traits_by_run(v, t, ",").collect()} == {1: "9,9,12", 2: "9,9,12", 3: "", 4: ""}
    assert {r.version_key: r.traits for r in ledgers.traits_by_run(v, t).collect()} == {1: [9, 9, 12], 2: [9, 9, 12], 3: [], 4: []}


def test_a_long_text_of_many_versions_is_written_once(spark, tmp_path):
    """A run's text of 1.6 MB is kept once for its 40 versions, by settings that the caller's session does not get."""
    spark.range(200_000).selectExpr("1000000 + id as l_orderkey", "int(1) as l_linenumber", "101 as l_suppkey").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(41).selectExpr("if(id = 40, 2, 1 + 60 * id) as p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    was = spark.conf.get("parquet.dictionary.page.size", None), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    QUERIES["traits_of_versions"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert was == (spark.conf.get("parquet.dictionary.page.size", None), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 4_000_000
    text = ",".join(str(10 * (1_000_000 + i) + 1) for i in range(200_000))
    got = {r.version_key: r.traits for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1 + 60 * i: text for i in range(40)} | {2: ""}


def test_joint_similarities_of_one_large_group(spark, tmp_path):
    """One group is shared by many tasks; every pair is there, by the plain formula."""
    spark.range(1, 301).selectExpr("id as c_custkey", "3 as c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(1, 41).selectExpr("id as s_suppkey", "3 as s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    df = edges.joint_similarities(spark, str(tmp_path)).withColumn("task", F.spark_partition_id())
    got = df.collect()
    y1, x1, y2, x2 = (math.radians(v) for v in (43, -97, 44.5, -96))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    s = math.exp(-((2 * 6371.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))) ** 2) / (2 * 150.0 * 150.0))
    assert len(got) == 12_000 and len({(r.a, r.b) for r in got}) == 12_000
    for r in got:
        t = max(0.0, 1 - abs(r.b * 60000 - r.a * 1000) / 3_600_000)
        assert abs(r.temporal - t) < 1e-6
        assert (r.spatial, r.joint) == (None, None) if r.b % 4 == 0 else abs(r.spatial - s) < 1e-6 and abs(r.joint - t * s) < 1e-6
    assert len({r.task for r in got}) > 8


def test_joint_similarities_with_missing_parts(spark):
    """Nulls and both zeros as the formula of one pair has them."""
    a = spark.createDataFrame([(1, "g", 0, 0.0, 1.0), (2, "g", None, -0.0, 1.0), (3, "g", 500, None, 1.0), (4, None, 0, 0.0, 1.0)], "a long, g string, t1 long, y1 double, x1 double")
    b = spark.createDataFrame([(1, "g", 100, 0.5, 1.5), (2, "g", 5000, -0.0, 1.0), (3, "g", 0, None, None), (4, "h", 0, 0.0, 1.0)], "b long, g string, t2 long, y2 double, x2 double")
    j = checks.joint_similarity(F.col("t1"), F.col("t2"), (F.col("y1"), F.col("x1")), (F.col("y2"), F.col("x2")), 1000, 150.0)
    want = a.join(b, "g").select("a", "b", j.alias("j")).select("a", "b", *(F.round(f"j.{c}", 6).alias(c) for c in ("temporal", "spatial", "joint")))
    assert sorted(map(str, checks.joint_similarities(a, b, "g", 1000, 150.0).collect())) == sorted(map(str, want.collect())) != []


def test_health_of_a_stream(spark):
    rows = [("s", i * 1000, 0.2 if i < 7 else 0.9) for i in range(22)]
    obs = spark.createDataFrame(rows, "stream_id string, ts_ms long, confidence double")
    streams = spark.createDataFrame([("s",), ("silent",)], "stream_id string")
    got = {r.stream_id: r for r in health.stream_health(obs, 30_000, streams).collect()}
    assert (got["s"].events, got["s"].low, got["s"].high, got["s"].severity, got["s"].alert) == (22, 7, 15, "info", True)
    assert round(got["s"].alert_confidence, 4) == 0.6818
    assert got["silent"].stale and got["silent"].severity == "high" and got["silent"].alert_confidence == 0.5


def test_source_readiness(spark):
    cs = spark.createDataFrame([(1, True), (2, False), (3, True), (4, True), (5, True)], "connector_id int, active boolean")
    sc = spark.createDataFrame([(i, True) for i in range(1, 6)], "connector_id int, schema_active boolean")
    h = spark.createDataFrame([(1, "healthy", "fresh", "stable"), (3, "failing", "fresh", "stable"), (4, "healthy", "unknown", "unknown")], "connector_id int, health string, freshness string, schema_state string")
    assert {r.connector_id: r.readiness for r in health.readiness(cs, h, sc).collect()} == {1: "ready", 2: "not_active", 3: "blocked", 4: "degraded", 5: "unknown"}
    jobs = spark.createDataFrame([("j", 1, "completed", 0, 50, 0, 0, 0)], "job_id string, connector_id int, status string, started_ms long, completed_ms long, fetched long, failed long, deduplicated long")
    r = health.job_health(jobs).first()
    assert (r.health, r.latency_ms, r.error_rate, r.freshness) == ("healthy", 50, None, "unknown")


def test_currentness_over_runs(spark):
    ex = spark.createDataFrame([("k1", "a", 1, 1, True, "r1"), ("k2", "b", 1, 1, True, "r1"), ("k3", "c", 1, 1, False, "r0")], "semantic_key string, candidate_hash string, first_ms long, seen_ms long, is_current boolean, last_run string")
    run = spark.createDataFrame([("k1", "a2"), ("k2", "b"), ("k3", "c"), ("k4", "d")], "semantic_key string, candidate_hash string")
    got = {r.candidate_hash: r for r in currentness.merged(ex, run, "r2", 9).collect()}
    assert {h: r.is_current for h, r in got.items()} == {"a": False, "a2": True, "b": True, "c": True, "d": True}
    assert (got["b"].first_ms, got["b"].seen_ms, got["b"].last_run) == (1, 9, "r2") and got["a2"].first_ms == 9
    cur = spark.createDataFrame([("r", "a", True), ("r", "b", True), ("q", "z", True), ("r", "o", False)], "rule_id string, candidate_hash string, is_current boolean")
    seen = spark.createDataFrame([("r", "a")], "rule_id string, candidate_hash string")
    assert [r.candidate_hash for r in currentness.retirements(cur, seen, True).collect()] == ["b"]
    assert currentness.retirements(cur, seen, False).count() == 0


def test_hops_in_a_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "c")], "src string, dst string")
    got = {r.node: r.hops for r in graph.hops(edges, "a", nodes).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": None}
    assert {r.node: r.hops for r in graph.hops(edges, "a", nodes, directed=True).collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None}


def test_relationship_strength(spark):
    m = spark.createDataFrame([(1, "a", "s", 0), (1, "b", "s", 0), (2, "a", "t", DAY_MS), (2, "b", "t", DAY_MS), (3, "a", "s", 0)], "signal_id long, entity_id string, stream_id string, ts_ms long")
    r = graph.relationships(m, 0.5, 0.3, 0.2, DAY_MS).first()
    assert (r.shared, r.buckets, r.streams) == (2, 2, 2) and r.jaccard == pytest.approx(2 / 3, abs=1e-9) and r.strength == pytest.approx(0.5 * 2 / 3 + 0.3 / 2 + 0.2, abs=1e-8)


def test_binding_of_traits(spark):
    v = spark.createDataFrame([("v1", "d", 1, ["x"]), ("v2", "d", 2, ["y"]), ("v3", "d", 2, ["y", "z"])], "version_key string, document_id string, run_id int, hashes array<string>")
    tr = spark.createDataFrame([(1, "d", 1, []), (2, "d", 9, ["x"]), (3, "d", 9, ["y"]), (4, "d", 2, ["z"]), (5, "e", 1, ["x"])], "trait_id int, document_id string, run_id int, hashes array<string>")
    got = {r.trait_id: (r.version_key, r.binding) for r in readmodels.bind_traits(tr, v).collect()}
    assert got == {1: ("v1", "exact"), 2: ("v1", "historical"), 3: (None, "unresolved"), 4: ("v3", "historical"), 5: (None, "unresolved")}


def test_form_extraction(spark):
    text = "UNEMPLOYMENT APPEAL FORM\nCalifornia: file your appeal within 3 weeks at https://edd.example.gov/appeal. Ask the EEOC, phone 206-555-0100. Unpaid wages."
    r = forms.forms(spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "id int, text string"), "id", "text").orderBy("id").collect()
    assert (r[0].url, r[0].form_name, r[0].d.days, r[0].method, [a.value for a in r[0].agencies], [j.value for j in r[0].jurisdictions]) == ("https://edd.example.gov/appeal", "UNEMPLOYMENT APPEAL FORM C", 21, "online", ["EEOC", "EDD"], ["CA"])
    assert r[0].confidence == 6.0 and r[0].status == "pending_live_verification" and r[1].status == "pending_enrichment" and "missing_url" in r[1].flags
    spots = spark.createDataFrame([(1, text)], "id int, text string").select(forms.scan(F.col("text")).alias("m")).first().m
    assert all(text[s.start : s.end].lower() == s.value.lower() for s in spots) and {s.kind for s in spots} == {"url", "phone", "action_keyword", "form_indicator", "deadline"}
    w = forms.windows(spark.createDataFrame([(1, 0, 10, 9999), (1, 1010, 1020, 9999), (1, 2021, 2030, 9999), (2, 5, 6, 50)], "id int, start long, end long, length long"), "id").orderBy("id", "start").collect()
    assert [(x.id, x.start, x.end, x.n) for x in w] == [(1, 0, 1520, 2), (1, 1521, 2530, 1), (2, 0, 50, 1)]


def test_sources_are_one_model(spark):
    import json

    from tallymark.sources import normalizers

    raw = {
        "cfpb_complaints": ({"complaint_id": "7", "state": "WA", "timely": "Yes", "date_received": "2024-01-02"}, ("consumer_complaint", "us_state_wa", "cfpb_7")),
        "nyc_311": ({"borough": "STATEN ISLAND", "unique_key": "9"}, ("municipal_service_request", "nyc_borough_staten_island", "nyc311_9")),
        "wa_ag": ({"business": "B", "openeddate": "2024-01-02"}, ("state_ag_consumer_complaint", "us_state_wa", "wa_ag_MjAyNC0wMS0wMnxC")),
        "sec_edgar": ({"form": "4", "cik": "1", "filed": "2024-01-02"}, ("insider_trade", "us_federal", "sec_1_4_2024-01-02")),
        "usa_spending": ({"total_obligation": 1000001, "award_id": "a", "recipient": {"location": {"state_code": "OR"}}}, ("large_federal_contract", "us_state_OR", "usaspend_a")),
        "epa_echo": ({"violations": 3, "registry_id": "r"}, ("environmental_violation", "us_federal", "epa_r")),
        "osha": ({"penalty": "1", "gravity": "High", "activity_nr": "1", "state": "TX"}, ("severe_workplace_violation", "us_state_TX", "osha_1")),
        "irs_527": ({"receipts": 500001, "name": "A B"}, ("large_dark_money_org", "us_federal", "irs527_A_B")),
        "fara_activity": ({"amount": 1, "id": "i"}, ("foreign_influence_activity", "us_federal", "fara_act_i")),
        "propublica_filing": ({"ein": "1"}, ("nonprofit_990_filing", "us_federal", "propublica_filing_1-unknown")),
        "agency_osha": ({"incident_type": "fall", "county": "King", "id": "5"}, ("fall", "King", "5")),
    }
    for name, (record, want) in raw.items():
        r = normalizers.normalize(spark.createDataFrame([(json.dumps(record),), (None,)], "raw string"), name).collect()
        assert len(r) == 2 and (r[0].signal_type, r[0].region, r[0].external_id) == want, name
    for name in normalizers.SOURCES:
        assert normalizers.normalize(spark.createDataFrame([("{}",), (None,), ("not json",)], "raw string"), name).count() == 3
    bad = normalizers.normalize(spark.createDataFrame([('{"state": "WA"}',)], "raw string"), "cfpb_complaints").first()
    assert bad.error == "identifier_required" and bad.ts_ms is None
    acs = spark.createDataFrame([(["NAME", "B01003_001E", "B17001_002E", "B23025_002E", "B23025_005E", "state", "county"], ["K", "200", "25", "100", "7", "53", "033"])], "header array<string>, values array<string>")
    r = normalizers.census_counties(acs, "2022").first()
    assert (r.external_id, r.poverty_rate, r.unemployment_rate) == ("census_acs_2022_53033", 12.5, 7.0)
    bls = spark.createDataFrame([("S", [("2024", "M03", "4.5")])], "series_id string, points array<struct<year:string,period:string,value:string>>")
    assert normalizers.employment_series(bls).first().external_id == "bls_S_2024_03"
    x = spark.createDataFrame([("SB 5001",), ("nothing",)], "b string").select(normalizers.bill_identifier(F.col("b")).alias("b")).collect()
    assert (x[0].b.prefix, x[0].b.number, x[1].b) == ("SB", 5001, None)


def test_streaming_equals_batch(spark, sf, tmp_path):
    from tallymark.streaming import ingest
    from tallymark.tables import resent

    rows = resent(spark, sf).withColumn("ts", F.timestamp_millis("ts_ms"))
    rows.repartition(5).write.parquet(str(tmp_path / "log"))
    log = lambda: ingest.read_log(spark, str(tmp_path / "log"), rows.schema, 1)
    ingest.drain(ingest.tumbling_activity(log(), late="60 days"), "activity", str(tmp_path / "c1"), "complete")
    batch = rows.groupBy((F.floor(F.col("ts_ms") / DAY_MS) * DAY_MS).alias("start_ms"), "stream_id", "category").agg(F.count("*").alias("n"))
    key = lambda df: sorted((r.start_ms, r.stream_id, r.category, r.n) for r in df.collect())
    assert key(spark.table("activity")) == key(batch)
    ingest.drain(ingest.first_deliveries(log(), late="60 days"), "firsts", str(tmp_path / "c2"))
    assert spark.table("firsts").count() == rows.select("stream_id", "identity_hash").distinct().count()
    ledger = f"{(tmp_path / 'ledger').as_uri()}"
    for _ in range(2):  # the second run delivers everything again
        log().writeStream.foreachBatch(ingest.append_ledger(ledger)).option("checkpointLocation", str(tmp_path / f"c{_ + 3}")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(ledger).count() == rows.select("stream_id", "identity_hash").distinct().count()




def test_write_once_is_idempotent_or_conflicts(spark, tmp_path):
    from tallymark.operators import intake

    path = (tmp_path / "run").as_uri()
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, digest string")
    assert intake.write_once(df, path, "digest") == "written"
    assert intake.write_once(df.orderBy(F.desc("id")), path, "digest") == "unchanged"
    with pytest.raises(ValueError):
        intake.write_once(df.limit(1), path, "digest")


def test_envelope_defaults_and_reasons(spark):
    from tallymark.operators import intake

    rows = spark.createDataFrame([(None, None, " ", "WA"), ("x", 7.0, "r", None), ("", 0.5, None, None)], "channel string, confidence double, region string, jurisdiction_id string")
    got = intake.envelope(rows).collect()
    assert [(r.channel, r.confidence, r.region, r.jurisdiction_id) for r in got] == [("external", 0.75, "WA", "WA"), ("x", 1.0, "r", "r"), ("external", 0.5, "unknown", "unknown")]
    why = spark.createDataFrame([("s", 1), (" ", 1), ("s", None)], "stream_id string, offset long").select(intake.invalid_reason(["stream_id", "offset"]).alias("w")).collect()
    assert [r.w for r in why] == [None, "missing_stream_id", "missing_offset"]
