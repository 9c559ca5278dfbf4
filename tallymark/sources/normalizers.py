"""Public-record sources as one observation model.

A source is a declaration: where each field of the envelope is found in the raw record, as JSON paths in
order of preference, and how its signal type follows. ``normalize`` turns the declaration into one
projection over a column of raw JSON text; there is no code per record and no Python at run time.

Rows whose identifier is required and missing are kept with ``error`` set, never dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import base64url, half_up

RAW = "raw"


def first(*paths: str, default: str | None = None) -> Column:
    """The first path of the raw record that holds a non-empty text."""
    found = [F.nullif(F.get_json_object(RAW, f"$.{p}"), F.lit("")) for p in paths]
    return F.coalesce(*found, F.lit(default).cast("string"))


def amount(*paths: str) -> Column:
    """A number, 0 where there is none."""
    return F.coalesce(first(*paths).try_cast("double"), F.lit(0.0))


def moment(*paths: str) -> Column:
    """Milliseconds of the first of paths that is a time; null otherwise. Times without a zone are UTC."""
    return F.coalesce(*(F.unix_millis(F.try_to_timestamp(F.regexp_replace(first(p), r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00Z"))) for p in paths))


def state_region(state: Column, lower: bool = False) -> Column:
    s = F.lower(state) if lower else state
    return F.coalesce(F.concat(F.lit("us_state_"), s), F.lit("us_federal"))


def external_id(prefix: str, ids: list[str], fallback: list[str]) -> Column:
    """prefix and the first id, else a base64url of the other fields, cut at 96 signs; null if none."""
    rest = F.nullif(F.concat_ws("|", *map(first, fallback)), F.lit("")) if fallback else F.lit(None).cast("string")
    return F.concat(F.lit(prefix + "_"), F.coalesce(first(*ids) if ids else F.lit(None).cast("string"), F.substring(base64url(rest), 1, 96)))


@dataclass(frozen=True)
class Source:
    channel: str
    system: str
    signal: Callable[[], Column]
    time: tuple[str, ...]
    external: Callable[[], Column]
    region: Callable[[], Column] = lambda: F.lit("us_federal")
    jurisdiction: Callable[[], Column] | None = None  #: the region where unset
    fields: dict[str, Callable[[], Column]] = field(default_factory=dict)
    required: tuple[str, ...] = ()


def _text(*paths: str, default: str | None = None, cut: int | None = None):
    return lambda: F.substring(first(*paths, default=default), 1, cut) if cut else first(*paths, default=default)


def _fixed(value: str):
    return lambda: F.lit(value)


def _federal() -> Column:
    return F.lit("us_federal")


def _flag(condition: Callable[[], Column], yes: str, no: str):
    return lambda: F.when(F.coalesce(condition(), F.lit(False)), yes).otherwise(no)


def _form() -> Column:
    return F.coalesce(first("form", "formType"), F.lit(""))


def _violations() -> Column:
    return amount("CWAVioCount", "violations")


def _severe() -> Column:
    return (amount("total_current_penalty", "penalty") > 50000) | (first("gravity") == "High") | (first("viol_type", "violation_type") == "Willful")


def _agency(name: str, signal: str) -> Source:
    """Records of one agency in many shapes, by lists of preference."""
    region = _text("jurisdiction", "region", "county", "state", "state_code", "location.state", "establishment_state", "company_state", default="us_federal")
    return Source(
        name, name, _text("complaint_type", "issue", "basis", "violation_type", "incident_type", default=signal),
        ("timestamp", "date_received", "received_date", "filing_date", "violation_date", "inspection_date", "incident_date", "open_date", "created_at"),
        _text("complaint_id", "charge_id", "case_id", "activity_nr", "id"), region, None,
        {"employer": _text("employer", "company", "establishment_name", "respondent"), "county": _text("county", "establishment_county", "location.county"), "source_url": _text("source_url", "sourceUrl", "url", "original_url", "pdf_url", "document_url")},
    )


def _id(prefix: str, *paths: str, fallback: tuple[str, ...] = ()):
    return lambda: external_id(prefix, list(paths), list(fallback))


# The sources' field names, signal types, thresholds, channels and identifiers' prefixes.
SOURCES: dict[str, Source] = {
    "cfpb_complaints": Source("cfpb", "cfpb_complaints_database", _fixed("consumer_complaint"), ("date_received", "created_date"), _id("cfpb", "complaint_id", "_id", "id"), lambda: state_region(first("state"), lower=True), None,
        {"company": _text("company", default="Unknown"), "product": _text("product"), "issue": _text("issue"), "timely": lambda: F.coalesce(first("timely") == "Yes", F.lit(False)).cast("string"), "narrative": _text("complaint_what_happened", cut=2000)}, ("complaint_id", "_id", "id")),
    "wa_ag": Source("wa_ag", "washington_attorney_general_consumer_protection", _fixed("state_ag_consumer_complaint"), ("openeddate",), _id("wa_ag", "id", fallback=("openeddate", "business", "businesscity", "businesscategory")), _fixed("us_state_wa"), None,
        {"business_name": _text("business", default="Unknown Business"), "category": _text("businesscategory"), "status": _text("status")}),
    "oregon": Source("oregon_complaints", "oregon_consumer_complaints", _fixed("state_consumer_complaint"), ("date_opened", "date_closed"), _id("oregon", "reference_no_", "id", fallback=("date_opened", "respondent", "city")), _fixed("us_state_or"), None,
        {"business_name": _text("respondent", default="Unknown Business"), "status": _text("status")}),
    "nyc_311": Source("nyc_311", "new_york_city_311", _fixed("municipal_service_request"), ("created_date",), _id("nyc311", "unique_key", fallback=("created_date", "agency", "complaint_type", "borough", "incident_address")),
        lambda: F.coalesce(F.concat(F.lit("nyc_borough_"), F.replace(F.lower(first("borough")), F.lit(" "), F.lit("_"))), F.lit("us_city_nyc")), _fixed("us_city_nyc"), {"agency": _text("agency"), "complaint_type": _text("complaint_type")}),
    "chicago_311": Source("chicago_311", "chicago_311", _fixed("municipal_service_request"), ("created_date",), _id("chicago311", "sr_number", fallback=("created_date", "sr_type", "street_address")), _fixed("us_city_chicago"), None, {"complaint_type": _text("sr_type"), "status": _text("status")}),
    "fec_committee": Source("fec", "federal_election_commission", _fixed("campaign_finance_committee"), ("last_file_date", "first_file_date"), _id("fec", "committee_id", "id"), lambda: state_region(first("state")), _federal,
        {"name": _text("name", default="Unknown Committee"), "review_reasons": lambda: F.array_join(F.array_compact(F.array(
            F.when(F.lower(first("committee_type_full", "committee_type", default="unknown")).contains("super pac"), "source_classifies_super_pac"),
            F.when(F.lower(first("designation_full", "designation")).contains("unauthorized"), "source_classifies_unauthorized"),
            F.when(F.lower(first("committee_type_full", "committee_type", default="unknown")).contains("independent") & first("party_full", "party").isNull(), "independent_committee_without_declared_party"))), ",")}),
    "fec_disbursement": Source("fec", "federal_election_commission", _fixed("campaign_disbursement"), ("disbursement_date",),
        lambda: F.concat(F.lit("fec_disb_"), F.coalesce(first("sub_id", "transaction_id"), F.sha2(F.to_json(F.struct(*(first(p).alias(p) for p in ("committee_id", "recipient_committee_id", "recipient_name", "disbursement_amount", "disbursement_date", "purpose")))), 256))),
        lambda: state_region(first("recipient_state")), _federal,
        {"from_id": lambda: F.concat(F.lit("fec:committee:"), first("committee_id")), "to_id": lambda: F.concat(F.lit("fec:committee:"), first("recipient_committee_id", "recipient.committee_id")),
         "is_transfer": lambda: (first("committee_id").isNotNull() & first("recipient_committee_id", "recipient.committee_id").isNotNull() & (amount("disbursement_amount") > 0) & moment("disbursement_date").isNotNull()).cast("string")}),
    "sec_edgar": Source("sec_edgar", "sec_edgar", lambda: F.when(_form().isin("4", "4/A"), "insider_trade").when(_form().startswith("8-K"), "material_corporate_event").when(_form().startswith("13F"), "institutional_holdings").otherwise("corporate_filing"),
        ("file_date", "filed", "dateFiled"), lambda: F.concat_ws("_", F.lit("sec"), F.coalesce(first("entity_id", "cik"), F.lit("")), _form(), F.coalesce(first("file_date", "filed", "dateFiled"), F.lit(""))), fields={"company_name": _text("companyName", "entity_name", "display_names[0]", default="Unknown"), "cik": _text("entity_id", "cik")}),
    "usa_spending": Source("usa_spending", "usaspending_gov", _flag(lambda: amount("total_obligation", "Award_Amount") > 1_000_000, "large_federal_contract", "federal_contract_award"), ("period_of_performance_start_date", "start_date", "action_date"),
        _id("usaspend", "generated_internal_id", "award_id", "id"), lambda: state_region(first("recipient.location.state_code", "recipient_state")), _federal,
        {"recipient_name": _text("recipient.recipient_name", "recipient_name", default="Unknown"), "agency": _text("awarding_agency.toptier_agency.name", "awarding_agency_name"), "description": _text("description", cut=500)}),
    "epa_echo": Source("epa_echo", "epa_echo_enforcement", _flag(lambda: _violations() > 3, "repeat_environmental_violator", "environmental_violation"), ("CWALastInspDate", "last_inspection"), _id("epa", "RegistryID", "registry_id"), lambda: state_region(first("FacState", "state")), None,
        {"facility_name": _text("FacName", "facility_name", default="Unknown Facility"), "violation_count": lambda: F.floor(_violations()).cast("string")}),
    "osha": Source("osha", "osha_enforcement", _flag(_severe, "severe_workplace_violation", "workplace_safety_inspection"), ("open_date", "inspection_date"), _id("osha", "activity_nr", "inspection_id"), lambda: state_region(first("site_state", "state")), None, {"establishment_name": _text("estab_name", "establishment_name", default="Unknown")}),
    "irs_527": Source("irs_527", "irs_political_org_filings", _flag(lambda: amount("total_receipts", "receipts", "Total_Receipts") > 500_000, "large_dark_money_org", "political_527_org"), ("filing_date", "date"),
        lambda: F.concat(F.lit("irs527_"), F.coalesce(first("ein", "EIN"), F.substring(F.regexp_replace(first("name", "org_name", "organization_name", default="Unknown"), r"\s+", "_"), 1, 30))), lambda: state_region(first("state", "STATE")), _federal, {"name": _text("name", "org_name", "organization_name", default="Unknown")}),
    "irs_501c4": Source("irs_exempt_org", "irs_exempt_organizations", _flag(lambda: amount("revenue_amount", "total_revenue") > 1_000_000, "large_social_welfare_org", "social_welfare_501c4"), ("ruling_date", "tax_period"), _id("irs501c4", "ein", "EIN"), lambda: state_region(first("state", "STATE")), _federal, {"name": _text("name", "organization_name", "org_name", default="Unknown")}),
    "fara_registrant": Source("doj_fara", "fara_efile", _fixed("foreign_agent_registration"), ("Registration_Date", "date"), _id("fara", "Registration_Number", "reg_number", "id"), lambda: state_region(first("State", "state")), _federal,
        {"name": _text("Name", "registrant_name", "name", default="Unknown"), "country": _text("Country", "country"), "status": _text("Status", "status", default="Active")}),
    "fara_activity": Source("doj_fara", "fara_efile", _flag(lambda: amount("amount", "payment") > 100_000, "large_foreign_influence_payment", "foreign_influence_activity"), ("date", "Date"),
        lambda: F.concat(F.lit("fara_act_"), F.coalesce(first("id"), F.regexp_replace(F.concat_ws("_", F.coalesce(first("registrant_name", "Registrant"), F.lit("")), F.coalesce(first("date", "Date"), F.lit(""))), r"\s+", "_"))), fields={"registrant_name": _text("registrant_name", "Registrant"), "country": _text("country", "Country")}),
    "hud_fmr": Source("hud_fmr", "hud_user_api", _fixed("housing_affordability"), ("year_start",), _id("hud_fmr", "fips_code", "county_code", "fips"), lambda: F.concat(F.lit("us_county_"), F.coalesce(first("fips_code", "county_code", "fips"), F.lit(""))), lambda: F.concat(F.lit("us_state_"), first("state_alpha", "state", default="WA")),
        {"county_name": _text("county_name", "areaname", "metro_name", default="Unknown"), "median_rent": _text("fmr_2", "Two_Bedroom")}),
    "usda_snap": Source("usda_fns", "usda_snap_retailer_locator", _fixed("snap_retailer_location"), ("observed_at",), lambda: F.concat(F.lit("snap_"), F.coalesce(first("attributes.ObjectId", "attributes.OBJECTID", "attributes.Store_Name", "ObjectId", "OBJECTID", "Store_Name"), F.sha2(F.col(RAW), 256))),
        lambda: F.concat(F.lit("us_state_"), first("attributes.State", "attributes.state", "State", "state", default="WA")), None, {"store_name": _text("attributes.Store_Name", "Store_Name", "store_name", default="Unknown Retailer"), "latitude": _text("geometry.y", "latitude", "Latitude")}),
    "court_listener": Source("courtlistener", "courtlistener", _fixed("court_opinion"), ("date_filed", "dateFiled", "date_created"), _id("courtlistener", "id", "cluster_id", "absolute_url"), _text("court.jurisdiction", "court_jurisdiction", "court_id", "court", default="us_federal"), None, {"case_name": _text("case_name", "caseName", default="Unknown Case")}),
    "grants_gov": Source("grants_gov", "grants_gov", _fixed("grant_opportunity"), ("openDate", "open_date", "postedDate"), _id("grants_gov", "id", "opportunityId", "number"), fields={"title": _text("title", "opportunityTitle"), "agency": _text("agency", "agencyName", "agencyCode")}),
    "propublica_org": Source("pro_publica", "propublica_nonprofit_explorer", _fixed("nonprofit_profile"), ("updated_at", "updated"), _id("propublica", "ein", "strein", "id"), lambda: state_region(first("state")), None, {"name": _text("name", "sub_name", default="Unknown")}),
    "propublica_filing": Source("pro_publica", "propublica_nonprofit_explorer", _fixed("nonprofit_990_filing"), ("tax_period_end", "updated"), lambda: F.concat(F.lit("propublica_filing_"), F.coalesce(first("sub_id"), F.concat_ws("-", first("ein", default="unknown"), first("tax_prd", "tax_period", default="unknown")))), fields={"organization_name": _text("organization_name", "name")}),
    "open_states": Source("open_states", "openstates", _fixed("state_bill"), ("latest_action_date", "updated_at", "created_at"), _id("openstates", "id", "identifier"), lambda: state_region(first("jurisdiction.name", "jurisdiction"), lower=True), None, {"title": _text("title"), "identifier": _text("identifier")}),
    "regulations_gov": Source("regulations_gov", "regulations_gov", _fixed("federal_regulation"), ("attributes.postedDate", "attributes.lastModifiedDate"), _id("regs", "id"), fields={"agency_id": _text("attributes.agencyId"), "title": _text("attributes.title")}),
    "agency_cfpb": _agency("cfpb", "cfpb_complaint"),
    "agency_eeoc": _agency("eeoc", "eeoc_filing"),
    "agency_dol_whd": _agency("dol_whd", "dol_whd_violation"),
    "agency_osha": _agency("osha", "osha_incident"),
}


def normalize(records: DataFrame, source: str, raw: str = RAW) -> DataFrame:
    """The envelope of each record. records: a column of JSON text; other columns are dropped."""
    s = SOURCES[source]
    rows = records.select(F.col(raw).cast("string").alias(RAW))
    region = s.region()
    error = F.lit(None).cast("string")
    if s.required:
        error = F.when(first(*s.required).isNull(), F.lit("identifier_required"))
    payload = F.to_json(F.struct(*(v().cast("string").alias(k) for k, v in sorted(s.fields.items())))) if s.fields else F.lit("{}")
    return rows.select(
        F.lit(source).alias("source"), s.signal().alias("signal_type"), moment(*s.time).alias("ts_ms"), region.alias("region"), (s.jurisdiction() if s.jurisdiction else region).alias("jurisdiction"),
        F.lit(s.channel).alias("channel"), F.lit(s.system).alias("source_system"), F.lit(1.0).alias("confidence"), s.external().alias("external_id"), payload.alias("payload"), error.alias("error"))


def census_counties(rows: DataFrame, year: str) -> DataFrame:
    """Rows of a header table (columns: header array, values array) as county baselines."""
    value = lambda name: F.when(F.array_position("header", name) > 0, F.try_element_at("values", F.array_position("header", name).cast("int")))
    n = lambda name: F.coalesce(value(name).try_cast("double"), F.lit(0.0))
    labor = F.when(n("B23025_002E") == 0, F.lit(1.0)).otherwise(n("B23025_002E"))
    fips = F.concat(F.coalesce(value("state"), F.lit("53")), F.coalesce(value("county"), F.lit("000")))
    rate = lambda part, whole: half_up(F.when(whole > 0, part / whole).otherwise(F.lit(0.0)) * 100, 2)
    return rows.select(
        F.concat(F.lit(f"census_acs_{year}_"), fips).alias("external_id"), F.coalesce(value("NAME"), F.lit("Unknown County")).alias("county_name"), n("B01003_001E").alias("population"),
        rate(n("B17001_002E"), n("B01003_001E")).alias("poverty_rate"), rate(n("B23025_005E"), labor).alias("unemployment_rate"))


def employment_series(rows: DataFrame) -> DataFrame:
    """series_id, points (array of year, period, value) as a row for each month."""
    x = rows.select("series_id", F.inline("points"))
    month = F.lpad(F.replace("period", F.lit("M"), F.lit("")), 2, "0")
    return x.select("series_id", "year", month.alias("month"), F.col("value").try_cast("double").alias("value"), F.concat_ws("_", F.lit("bls"), "series_id", "year", month).alias("external_id"))


def code_family(subject: Column, families: dict[str, str], default: str = "other") -> Column:
    """The family of a code by a lookup of its upper-case text."""
    table = F.create_map(*(F.lit(x) for pair in families.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(subject))), F.lit(default))


def bill_identifier(x: Column) -> Column:
    """chamber prefix and number of a bill's identifier."""
    prefix = F.upper(F.regexp_extract(F.trim(x), r"^([A-Za-z]+)\s*\.?\s*(\d+)", 1))
    number = F.regexp_extract(F.trim(x), r"^([A-Za-z]+)\s*\.?\s*(\d+)", 2)
    return F.when(prefix != "", F.struct(prefix.alias("prefix"), number.cast("long").alias("number")))
