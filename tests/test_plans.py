"""Control objects: canonical JSON, filter and lens stacks, modules, receipts and replay."""

import pytest

from tallymark.plans import domains, filters, lenses, modules, receipts
from tallymark.plans.canonical import canonical, digest, number


def test_numbers_print_as_ecmascript_does():
    want = {1.0: "1", 0.1: "0.1", 1e21: "1e+21", 1e20: "100000000000000000000", 1e-7: "1e-7", 1e-6: "0.000001", -0.0: "0", 123456789.125: "123456789.125", 1.5e-10: "1.5e-10", 5e-324: "5e-324", 2**53: "9007199254740992", -1.25e22: "-1.25e+22"}
    assert {k: number(k) for k in want} == want


def test_canonical_json():
    assert canonical({"b": [1, 2.5, None, True], "a": "é\n"}) == '{"a":"é\\n","b":[1,2.5,null,true]}'
    assert digest({"a": 1, "b": 2}) == digest({"b": 2.0, "a": 1.0})
    for bad in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            canonical({"x": bad})
    with pytest.raises(TypeError):
        canonical({1, 2})


def test_filter_stack():
    s = filters.resolve(requested=["signal_type_scope", {"filter_id": "source_scope", "parameters": {"source_ids": ["b", "a", "a"]}}, {"filter_id": "unresolved_state_preservation", "enabled": False}])
    assert [f.kind.name for f in s.effective] == ["source_scope", "signal_type_scope", *sorted(filters.HARDENED)]
    assert s.blocked == ("unresolved_state_preservation",) and s.effective[0].parameters == {"source_ids": ["a", "b"]}
    again = filters.resolve(requested=[{"filter_id": "source_scope", "parameters": {"source_ids": ["a", "b"]}}, "signal_type_scope"])
    assert again.receipt == s.receipt
    for bad in (
        {"requested": ["nope"]}, {"requested": [{"filter_id": "source_scope", "parameters": {"x": 1}}]}, {"requested": [{"filter_id": "provenance_threshold", "parameters": {"minimum_confidence": 2}}]},
        {"requested": [{"filter_id": "convergence_window", "parameters": {"minimum_signal_count": 1}}]}, {"module_required": [{"filter_id": "source_scope", "enabled": False}]}, {"system": ["source_scope"]},
        {"requested": [{"filter_id": "provenance_threshold", "parameters": {"minimum_confidence": 0.1}}], "module_required": [{"filter_id": "provenance_threshold", "parameters": {"minimum_confidence": 0.2}}]},
    ):
        with pytest.raises(filters.FilterError):
            filters.resolve(**bad)


def test_pushed_filters_reach_the_scan(spark, sf):
    s = filters.resolve(requested=[{"filter_id": "source_scope", "parameters": {"source_ids": ["O", "F"]}}], system=())
    df = s.apply(spark.read.parquet(f"{sf}/orders.parquet"), {"source_ids": "o_orderstatus"}).select("o_orderkey")
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [In(o_orderstatus" in plan and "o_totalprice" not in plan.split("== Physical Plan ==")[1]


def test_lens_blend(spark):
    a = spark.createDataFrame([("s", "recurrence", "observed", 0.5, 2), ("s", "contradiction", "observed", 0.2, 1), ("s", "disconfirmation", "not_observed", None, 0), ("u", "recurrence", "observed", 0.5, 0), ("u", "contradiction", "observed", 0.2, 1)], "subject string, lens string, status string, score double, evidence int")
    got = {r.subject: r for r in lenses.blend(a, {"recurrence": 0.6, "contradiction": 0.4 - 1e-13, "disconfirmation": 1e-13}).collect()}
    assert got["s"].score == pytest.approx(0.38) and got["u"].score is None and got["u"].unresolved == 2
    for bad in ({}, {"nope": 1.0}, {"recurrence": 0.5}):
        with pytest.raises(ValueError):
            lenses.stack(bad)
    with pytest.raises(ValueError):
        lenses.stack({"recurrence": 1.0}, require_disconfirmation=True)


def test_modules_compile_to_stable_digests():
    make = lambda types: modules.Module("m", "1.0.0", "why?", domains.DomainSpace("vector", 1.0, 3), ({"connector_id": "c", "schema_id": "s", "adapter_class": "k", "required": True},), types, {"recurrence": 1.0})
    assert make(("b", "a")).compiled() == make(("a", "b", "a")).compiled()
    with pytest.raises(ValueError):
        modules.Module("m", "1.0", "why?", domains.DomainSpace("graph", 1.0), ({"connector_id": "c"},), ("a",), {"recurrence": 1.0})
    for bad in (("vector", 1.0), ("hybrid", 1.0), ("graph", 0)):
        with pytest.raises(ValueError):
            domains.DomainSpace(*bad)


def test_receipts_and_replay():
    m = receipts.Manifest("convergence", 1000, digest("rules"), digest("rows"), 3)
    r = receipts.issue(m, {"z": 1.5})
    assert r.verify(m, {"z": 1.5}) and not r.verify(m, {"z": 1.6})
    assert receipts.replay(r, m, lambda: {"z": 1.5}).ok and not receipts.replay(r, m, lambda: {"z": 2}).ok
    second = receipts.issue(m, {"z": 2}, r)
    assert receipts.chained([r, second]) and not receipts.chained([second, r])
    assert len({receipts.issue(m, {"z": 1.5}).identity for _ in range(100)}) == 1
    for bad in ({"rules": "short"}, {"signal_count": -1}, {"filters": "x"}):
        with pytest.raises(ValueError):
            receipts.Manifest(**({"computation": "c", "as_of_ms": 1, "rules": digest(1), "population": digest(2), "signal_count": 1} | bad))
