"""Every declared source over records that orders stand in for: the same short expressions write the raw
record in Spark and say in SQL what the envelope must hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import normalizers
from ..tables import read

QUERIES, ORACLES = {}, {}
_DAY = 1_704_153_600_000  # 2024-01-02
_D = "'2024-01-02'"
_ST, _RS = "concat('S', o_custkey % 5)", "concat('us_state_S', o_custkey % 5)"
_RL, _FED = "concat('us_state_s', o_custkey % 5)", "'us_federal'"
_SOME = "CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END"


def _case(cond: str, yes: str, no: str) -> str:
    return f"CASE WHEN {cond} THEN '{yes}' ELSE '{no}' END"


#: source -> (fields of the raw record; external id, signal type, region, jurisdiction (the region if unset), time, error)
CASES = {
    "cfpb_complaints": ({"complaint_id": _SOME, "state": _ST, "date_received": _D}, "'cfpb_' || " + _SOME, "'consumer_complaint'", _RL, None, _DAY, "CASE WHEN o_orderkey % 9 = 0 THEN 'identifier_required' END"),
    "wa_ag": ({"id": "o_orderkey", "openeddate": _D}, "concat('wa_ag_', o_orderkey)", "'state_ag_consumer_complaint'", "'us_state_wa'", None, _DAY, None),
    "oregon": ({"id": "o_orderkey", "date_closed": _D}, "concat('oregon_', o_orderkey)", "'state_consumer_complaint'", "'us_state_or'", None, _DAY, None),
    "nyc_311": ({"unique_key": "o_orderkey", "borough": "CASE WHEN o_orderkey % 2 = 0 THEN 'STATEN ISLAND' END", "created_date": _D}, "concat('nyc311_', o_orderkey)", "'municipal_service_request'", _case("o_orderkey % 2 = 0", "nyc_borough_staten_island", "us_city_nyc"), "'us_city_nyc'", _DAY, None),
    "chicago_311": ({"sr_number": "o_orderkey"}, "concat('chicago311_', o_orderkey)", "'municipal_service_request'", "'us_city_chicago'", None, None, None),
    "fec_committee": ({"committee_id": "o_orderkey", "state": _ST, "first_file_date": _D}, "concat('fec_', o_orderkey)", "'campaign_finance_committee'", _RS, _FED, _DAY, None),
    "fec_disbursement": ({"sub_id": "o_orderkey", "recipient_state": _ST, "disbursement_date": _D}, "concat('fec_disb_', o_orderkey)", "'campaign_disbursement'", _RS, _FED, _DAY, None),
    "sec_edgar": ({"form": "CASE o_orderkey % 4 WHEN 0 THEN '4' WHEN 1 THEN '8-K/A' WHEN 2 THEN '13F-HR' ELSE '10-K' END", "cik": "o_custkey", "filed": _D}, "concat('sec_', o_custkey, '_', CASE o_orderkey % 4 WHEN 0 THEN '4' WHEN 1 THEN '8-K/A' WHEN 2 THEN '13F-HR' ELSE '10-K' END, '_2024-01-02')", "CASE o_orderkey % 4 WHEN 0 THEN 'insider_trade' WHEN 1 THEN 'material_corporate_event' WHEN 2 THEN 'institutional_holdings' ELSE 'corporate_filing' END", _FED, None, _DAY, None),
    "osha": ({"activity_nr": "o_orderkey", "penalty": "o_totalprice", "gravity": "CASE WHEN o_orderkey % 4 = 0 THEN 'High' END", "site_state": _ST, "open_date": _D}, "concat('osha_', o_orderkey)", _case("o_totalprice > 50000 OR o_orderkey % 4 = 0", "severe_workplace_violation", "workplace_safety_inspection"), _RS, None, _DAY, None),
    "irs_527": ({"ein": "o_orderkey", "receipts": "o_totalprice * 3", "STATE": _ST, "date": _D}, "concat('irs527_', o_orderkey)", _case("o_totalprice * 3 > 500000", "large_dark_money_org", "political_527_org"), _RS, _FED, _DAY, None),
    "irs_501c4": ({"EIN": "o_orderkey", "total_revenue": "o_totalprice * 5", "state": _ST, "ruling_date": _D}, "concat('irs501c4_', o_orderkey)", _case("o_totalprice * 5 > 1000000", "large_social_welfare_org", "social_welfare_501c4"), _RS, _FED, _DAY, None),
    "fara_registrant": ({"reg_number": "o_orderkey", "state": _ST, "date": _D}, "concat('fara_', o_orderkey)", "'foreign_agent_registration'", _RS, _FED, _DAY, None),
    "fara_activity": ({"id": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END", "registrant_name": "concat('R ', o_custkey)", "payment": "o_totalprice", "Date": _D}, "CASE WHEN o_orderkey % 2 = 0 THEN concat('fara_act_', o_orderkey) ELSE concat('fara_act_R_', o_custkey, '_2024-01-02') END", _case("o_totalprice > 100000", "large_foreign_influence_payment", "foreign_influence_activity"), _FED, None, _DAY, None),
    "hud_fmr": ({"fips": "o_custkey", "state": _ST}, "concat('hud_fmr_', o_custkey)", "'housing_affordability'", "concat('us_county_', o_custkey)", _RS, None, None),
    "usda_snap": ({"ObjectId": "o_orderkey", "State": _ST}, "concat('snap_', o_orderkey)", "'snap_retailer_location'", _RS, None, None, None),
    "court_listener": ({"cluster_id": "o_orderkey", "court_id": "CASE WHEN o_orderkey % 3 <> 0 THEN concat('ca', o_custkey % 9) END", "date_filed": _D}, "concat('courtlistener_', o_orderkey)", "'court_opinion'", "CASE WHEN o_orderkey % 3 <> 0 THEN concat('ca', o_custkey % 9) ELSE 'us_federal' END", None, _DAY, None),
    "grants_gov": ({"opportunityId": "o_orderkey", "postedDate": _D}, "concat('grants_gov_', o_orderkey)", "'grant_opportunity'", _FED, None, _DAY, None),
    "propublica_org": ({"strein": "o_orderkey", "state": _ST, "updated": _D}, "concat('propublica_', o_orderkey)", "'nonprofit_profile'", _RS, None, _DAY, None),
    "propublica_filing": ({"ein": "o_custkey", "tax_period": "o_orderkey % 12", "updated": _D}, "concat('propublica_filing_', o_custkey, '-', o_orderkey % 12)", "'nonprofit_990_filing'", _FED, None, _DAY, None),
    "open_states": ({"identifier": "concat('SB ', o_orderkey)", "jurisdiction": _ST, "created_at": _D}, "concat('openstates_SB ', o_orderkey)", "'state_bill'", _RL, None, _DAY, None),
    "regulations_gov": ({"id": "o_orderkey"}, "concat('regs_', o_orderkey)", "'federal_regulation'", _FED, None, None, None),
    "agency_cfpb": ({"complaint_id": "o_orderkey", "issue": "o_orderpriority", "state": _ST, "received_date": _D}, "CAST(o_orderkey AS VARCHAR)", "o_orderpriority", _ST, None, _DAY, None),
    "agency_eeoc": ({"charge_id": "o_orderkey", "region": _ST, "filing_date": _D}, "CAST(o_orderkey AS VARCHAR)", "'eeoc_filing'", _ST, None, _DAY, None),
    "agency_dol_whd": ({"case_id": "o_orderkey", "violation_type": "o_orderstatus", "violation_date": _D}, "CAST(o_orderkey AS VARCHAR)", "o_orderstatus", _FED, None, _DAY, None),
    "agency_osha": ({"id": "o_orderkey", "incident_date": _D, "county": "concat('C', o_custkey % 3)"}, "CAST(o_orderkey AS VARCHAR)", "'osha_incident'", "concat('C', o_custkey % 3)", None, _DAY, None),
}


def _normalized(spark, sf_dir, source):
    fields = CASES[source][0]
    raw = F.to_json(F.struct(*(F.expr(e).alias(name) for name, e in fields.items())))
    x = normalizers.normalize(read(spark, sf_dir, "orders").select(raw.alias("raw")), source)
    return x.select("external_id", "signal_type", "region", "jurisdiction", "ts_ms", "error")


for _source, (_, _external, _signal, _region, _jurisdiction, _ms, _error) in CASES.items():
    QUERIES[f"source_{_source}"] = lambda spark, sf_dir, source=_source: _normalized(spark, sf_dir, source)
    ORACLES[f"source_{_source}"] = f"SELECT {_external} AS external_id, {_signal} AS signal_type, {_region} AS region, {_jurisdiction or _region} AS jurisdiction, CAST({_ms or 'NULL'} AS BIGINT) AS ts_ms, CAST({_error or 'NULL'} AS VARCHAR) AS error FROM orders"
