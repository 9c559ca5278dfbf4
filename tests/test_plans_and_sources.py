"""Registries, paged services, rule manifests, snapshots, acceptance, ledgers of resolutions."""

import copy
import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tallymark.functions import checks
from tallymark.operators import forms, ledgers, schedule
from tallymark.plans import receipts, rules, snapshots
from tallymark.plans.canonical import digest
from tallymark.sources import geography, paged
from tallymark.storage import checkpoint_dir


def record(i, **more):
    return {"jurisdiction_id": i, "source_id": "s", "name": i, "level": "county", "fips_code": "53001", "area_sq_km": 5.0, "centroid_lat": 47.0, "centroid_lon": -120.0, "adjacent_to": []} | more


def test_geography_files(spark, tmp_path):
    good = {"source_id": "s", "source_version": "v", "jurisdiction": "us", "records": [record("a", adjacent_to=["b"]), record("b", adjacent_to=["a"])]}
    (tmp_path / "g.json").write_text(json.dumps(good, indent=2))
    g = geography.load(spark, str(tmp_path / "g.json"))
    assert sorted(r.node for r in g.runtime.collect()) == ["A", "B"] and g.adjacency.count() == 2 and len(g.version) == 64
    (tmp_path / "h.json").write_text(json.dumps(good | {"records": good["records"][::-1]}))
    assert geography.load(spark, str(tmp_path / "h.json")).version == g.version  # order does not matter
    (tmp_path / "i.json").write_text(json.dumps(good | {"records": [record("a", adjacent_to=["b"], area_sq_km=6.0), record("b", adjacent_to=["a"])]}))
    assert geography.load(spark, str(tmp_path / "i.json")).version != g.version
    for name, bad in (("no_source", good | {"source_id": None}), ("no_records", good | {"records": []}), ("one_way", good | {"records": [record("a", adjacent_to=["b"]), record("b")]}), ("fips", good | {"records": [record("a", fips_code="x")]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            geography.load(spark, str(tmp_path / f"{name}.json"))
    assert geography.listed(spark, str(tmp_path / "g.json")).first().records == 2


def test_paged_service(spark):
    asked, failed = [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            if q["$offset"] == "40" and not failed:
                failed.append(1)
                self.send_error(503)
                return
            asked.append((int(q["$offset"]), int(q["$limit"]), q.get("$where")))
            body = json.dumps([{"n": i} for i in range(int(q["$offset"]), min(95, int(q["$offset"]) + int(q["$limit"])))]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = paged.pages(spark, f"http://127.0.0.1:{server.server_port}/r.json", limit=110, page=20, where="n > 0", order="n").collect()
    server.shutdown()
    assert sorted(json.loads(r.raw)["n"] for r in got) == list(range(95)) and all(json.loads(r.raw)["n"] == r.offset for r in got)
    assert sorted(asked) == [(at, min(20, 110 - at), "n > 0") for at in range(0, 110, 20)] and failed
    assert paged._Reader({"path": "x", "limit": "999999", "page": "999999"}).limit == paged.MOST


def test_rule_manifest():
    m = rules.manifest()
    assert m["count"] == 13 and len(m["digest"]) == 64 and m["digest"] != rules.manifest(rules.RULES[::-1])["digest"]
    with pytest.raises(ValueError):
        rules.manifest(rules.RULES + rules.RULES[:1])
    with pytest.raises(ValueError):
        rules.manifest(rules.RULES[:-1])
    assert [r.entity_role for r in rules.applicable("sec_edgar", "x")] == ["issuer"] and len(rules.applicable("unheard", "x")) == 2
    assert [r.rule_id for r in rules.applicable("pro_publica", "nonprofit_990")] == ["pro_publica.nonprofit_990.subject_nonprofit"]


CONTRACT = ("c", "1")


def snapshot(**more):
    versions = [{"bill_version_id": "v1", "stage_order": 1, "processing_state": "done", "extraction_run_id": "r"}, {"bill_version_id": "v2", "stage_order": 2, "processing_state": "failed"}]
    part = lambda i, kind, value: {"component_id": f"ns:{i}", "component_type": kind, "canonical_record_id": str(i), "inclusion_state": "in", "jurisdiction_code": None, "temporal_scope": None, "value": value, "source_bindings": [{"b": 2}, {"a": 1}], "source_verification": ["x"], "unresolved_conditions": []}
    parts = [part(1, "bill", {"bill_versions": versions, "bill_version_manifest": {"version_count": 2, "manifest_hash": digest(versions)}}), part(2, "trait", {"extraction_run_id": "r"}), part(3, "trait", {"extraction_run_id": "q"})]
    for c in parts:
        c["component_hash"] = digest(snapshots.component_basis(c))
    s = {"contract_id": "c", "contract_version": "1", "canonical_owner": "o", "snapshot_id": "s1", "snapshot_kind": "baseline_export", "immutable": True, "scope": {"scope_type": "family", "scope_ids": ["f"], "jurisdiction_codes": ["WA"]}, "as_of": "2024-01-01T00:00:00Z", "methodology_version": "m", "components": parts, "component_count": 3, "unresolved_conditions": [], "excluded_component_types": [], "completeness_state": "full"} | more
    own = s["snapshot_hash"] = digest(snapshots.snapshot_basis(s))
    basis = {"export_receipt_id": "e", "snapshot_hash": own, "deterministic_replay_key": snapshots.replay_key(s, own), "source_commit_sha": None}
    s["export_receipt"] = basis | {"export_receipt_hash": digest(basis), "generated_at": "2024-01-02T00:00:00Z"}
    return s


def test_snapshots_are_checked_and_taken_in_once(spark):
    good, types = snapshot(), frozenset({"bill", "trait"})
    again = copy.deepcopy(good)
    again["components"][0]["source_bindings"].reverse()  # the order of bindings is not part of it
    bad = {}
    for name, change in (("component_hash_mismatch", lambda s: s["components"][1].update(value={"x": 1})), ("snapshot_hash_mismatch", lambda s: s.update(completeness_state="part")), ("component_count_mismatch", lambda s: s.update(component_count=2)), ("replay_key_mismatch", lambda s: s["export_receipt"].update(deterministic_replay_key="0" * 64)),
                         ("export_receipt_hash_mismatch", lambda s: s["export_receipt"].update(export_receipt_id="z")), ("contract_mismatch", lambda s: s.update(contract_id="z")), ("source_boundary_mismatch", lambda s: s.update(immutable=False)), ("component_type_not_governed", lambda s: s["components"][0].update(component_type="odd"))):
        bad[name] = copy.deepcopy(good)
        change(bad[name])
    rows = [(json.dumps(s),) for s in (good, again, *bad.values())] + [("no json",), (None,), ("[]",)]
    found = snapshots.checked(spark.createDataFrame(rows, "body string"), CONTRACT, "o", types, "ns:")
    got = [r.reason for r in found.collect()]
    assert got == [None, None, *bad, "malformed", "not_an_object", "not_an_object"]
    stored = spark.createDataFrame([], "body string, snapshot_id string, snapshot_hash string")
    new = snapshots.taken_in(found, stored)
    assert [r.snapshot_id for r in new.collect()] == ["s1"] and snapshots.taken_in(found, new).count() == 0
    with pytest.raises(snapshots.SnapshotError):
        snapshots.taken_in(found, spark.createDataFrame([("x", "s1", "0" * 64)], stored.schema))
    assert [(r["version_id"], r["place"], r["traits"]) for r in snapshots.legislative_rows(good)] == [("v1", 1, 1), ("v2", 2, 0)]
    with pytest.raises(snapshots.SnapshotError):
        snapshots.legislative_rows(snapshot(components=[]))


def test_acceptance_needs_persistence_and_an_equal_replay():
    m = receipts.Manifest("c", 1, "a" * 64, "b" * 64, 3)
    assert receipts.accept(m, lambda: {"x": 1}, lambda r, o: "written")["replay_consistent"]
    with pytest.raises(receipts.AcceptanceError):
        receipts.accept(m, lambda: {"x": 1}, lambda r, o: "skipped")
    seen = []
    with pytest.raises(receipts.AcceptanceError):
        receipts.accept(m, lambda: seen.append(1) or len(seen), lambda r, o: "written")


def test_batches_refuse_as_a_whole(spark):
    rows = spark.createDataFrame([("s", 1, "k", "h", None), ("s", 2, "k", "h", "invalid_hash")], "stream_id string, offset long, candidate_key string, resolution_hash string, reason string")
    stored = rows.drop("reason").limit(0).withColumn("is_current", F.lit(True))
    with pytest.raises(ValueError, match="invalid_hash"):
        ledgers.persisted_resolutions(rows, stored)
    with pytest.raises(ValueError, match="at most 1"):
        ledgers.persisted_resolutions(rows, stored, most=1)
    assert [r.is_current for r in ledgers.persisted_resolutions(rows.where("reason is null"), stored).collect()] == [True]
    with pytest.raises(ValueError, match="not cut"):
        ledgers.whole(spark.range(5), most=4)
    with pytest.raises(ValueError, match="rumour|fail"):
        ledgers.civic_upsert(spark.range(0), spark.createDataFrame([("x",)], "reason string"))


def test_single_flight_and_windows(spark):
    a = spark.createDataFrame([("a",), ("a",), ("b",)], "adapter string")
    assert [r.adapter for r in schedule.claimed(a, spark.createDataFrame([("b",)], "adapter string")).collect()] == ["a"]
    w = spark.range(1).select(checks.window_error(F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-02T00:00:00Z"), F.lit("2024-01-02T00:00:00Z")).alias("e"), checks.window_length(F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-02T00:00:00Z")).alias("n")).first()
    assert w.e is None and w.n == 86_400_000
    assert checkpoint_dir(spark)


def test_forms_of_long_texts_come_by_blocks_of_context(spark):
    one = "UNEMPLOYMENT APPEAL FORM.\nAsk the EDD: https://edd.example.gov/appeal. You must appeal within 10 days."
    text = one + " " + "zzz " * 600 + one + " " + "zzz " * 600 + "File a claim by phone 206-555-0100."
    x = forms.extracted(spark.createDataFrame([(1, text), (2, "zzz " * 9), (3, None)], "id int, text string"), "id", "text").orderBy("start").collect()
    assert [(r.id, r.group_size, r.normalized_url) for r in x] == [(1, 2, "https://edd.example.gov/appeal"), (1, 1, None)]  # two blocks say the same
    assert x[0].start == 0 and x[0].d.days == 10 and [a.value for a in x[0].agencies] == ["EDD"] and x[1].end == len(text)
    name = spark.createDataFrame([("Housing Help Desk\nWhere to go\nSee www.example.org today",), ("Tenant Help\nplease apply soon",), ("nothing",)], "t string").select(forms.form_name(F.col("t")).alias("n")).collect()
    assert [r.n and tuple(r.n) for r in name] == [("Housing Help Desk", "heading_near_url"), ("Tenant Help", "label_before_action"), None]


def test_all_rules_extract_in_one_pass(spark):
    from tallymark.operators import intake

    events = [
        ("cfpb_complaints", 1, {"payload": {"company": " Big  Bank "}}), ("cfpb_complaints", 2, {"payload": {}}), ("open_states", 1, {"payload": {"sponsor": "A. One", "sponsors": ["A. One", "B. Two", " ", None]}}),
        ("usa_spending", 1, {"payload": {"recipient": "R", "uei": "U1", "duns": "D1", "agency": "GSA"}}), ("usa_spending", 2, {"payload": {"duns": "D2"}}), ("unheard", 1, {"payload": {"company": "x"}}),
    ]
    rows = spark.createDataFrame([(s, o, json.dumps(e)) for s, o, e in events], "stream_id string, offset long, event string")
    got = intake.entity_candidates(rows, rules.extraction())
    assert got.columns == ["stream_id", "offset", "role", "expected_type", "place", "name", "id_kind", "id_value"]
    assert sorted((r.stream_id, r.offset, r.role, r.name or "", r.id_kind or "", r.id_value or "") for r in got.collect()) == sorted([
        ("cfpb_complaints", 1, "complained_against_entity", "Big Bank", "", ""), ("cfpb_complaints", 2, "ignored", "", "", ""), ("open_states", 1, "legislative_sponsor", "A. One", "", ""), ("open_states", 1, "legislative_sponsor", "B. Two", "", ""),
        ("usa_spending", 1, "award_recipient", "R", "uei", "U1"), ("usa_spending", 1, "awarding_agency", "GSA", "", ""), ("usa_spending", 2, "award_recipient", "", "duns", "D2"), ("unheard", 1, "ignored", "", "", "")])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
