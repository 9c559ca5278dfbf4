"""From delivered rows to signals: defaults, validation with reasons, extraction by preference, write-once
persistence. Rows that cannot be used are kept apart with why, never lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, first_text, geography_key, let, squeezed
from ..tables import joined_hash

# Where fields are found in a delivered event, in order of preference.
CATEGORY = ("payload.normalized_category", "payload.category", "payload.issue", "payload.product", "payload.subject", "payload.ntee_code", "payload.raw.category", "payload.raw.issue", "payload.raw.product", "signal_type")
JURISDICTION = ("jurisdiction_id", "spacetime.jurisdiction", "spacetime.state", "spacetime.region")
GEOGRAPHY = ("spacetime.city", "spacetime.county", "spacetime.county_name", "spacetime.zip", "spacetime.zip_code", "spacetime.region")
NAMES = ("company", "company_name", "organization_name", "employer_name", "recipient_name", "candidate_name", "agency_name", "entity_name", "name")
ENTITY = ("payload.canonical_entity_name", *(f"payload.{n}" for n in NAMES), *(f"payload.raw.{n}" for n in NAMES))
CONFIDENCE = ("payload.confidence_score", "payload.confidence", "provenance.confidence")
DOMAIN_OF_ADAPTER = {
    "cfpb": "consumer_protection", "osha": "labor", "epa": "environment", "hud": "housing", "courtlistener": "judicial", "openstates": "legislative", "bls": "labor", "census": "civic", "fec": "fiscal", "sec": "fiscal",
    "usaspending": "fiscal", "irs": "fiscal", "opensecrets": "legislative", "fara": "legislative", "regulationsgov": "regulatory", "grantsgov": "civic", "propublica": "legislative"}
DOMAIN_WORDS = {
    "housing": ("eviction", "rent", "lease", "tenant", "housing"), "labor": ("wage", "labor", "employment", "osha", "workplace"), "benefits": ("snap", "benefit", "medicaid", "unemployment"),
    "consumer_protection": ("claim denied", "coverage denied", "insurance"), "healthcare": ("hospital", "medical", "healthcare"), "judicial": ("court", "lawsuit", "petition", "hearing")}


def at(event: str, *paths: str) -> Column:
    """The first non-empty text at paths of a column of JSON events."""
    return first_text(*(F.get_json_object(event, f"$.{p}") for p in paths))


def described(events: DataFrame, event: str = "event") -> DataFrame:
    """events with category, jurisdiction, geography and entity."""
    return (
        events.withColumn("category", F.coalesce(at(event, *CATEGORY), F.lit("unclassified"))).withColumn("jurisdiction", F.coalesce(at(event, *JURISDICTION), F.lit("unknown")))
        .withColumn("geography", at(event, *GEOGRAPHY)).withColumn("entity", at(event, *ENTITY))
    )


def envelope(events: DataFrame) -> DataFrame:
    """Delivered rows with the defaults of the log: channel external, confidence 0.75 and within [0, 1],
    region and jurisdiction standing in for each other."""
    return (
        events.withColumn("channel", F.coalesce(squeezed(F.col("channel")), F.lit("external"))).withColumn("confidence", clamp(F.coalesce("confidence", F.lit(0.75)), 0, 1))
        .withColumn("region", F.coalesce(squeezed(F.col("region")), squeezed(F.col("jurisdiction_id")), F.lit("unknown"))).withColumn("jurisdiction_id", F.coalesce(squeezed(F.col("jurisdiction_id")), F.col("region")))
    )


def invalid_reason(required: list[str]) -> Column:
    """The first required text that is missing, as missing_<field>; null where none is."""
    why = F.lit(None).cast("string")
    for f in reversed(required):
        why = F.when(squeezed(F.col(f).cast("string")).isNull(), F.lit(f"missing_{f}")).otherwise(why)
    return why


def to_signals(events: DataFrame, registry: DataFrame, level: str) -> DataFrame:
    """Each event as a signal, with ``reason`` where it cannot be one. events: stream_id, offset,
    signal_type, timestamp (text), identity_hash, place (text), confidence (text); registry: key (upper
    case), geography, level, one row a key."""
    ms = F.unix_millis(F.try_to_timestamp("timestamp"))
    x = events.withColumn("key", geography_key(F.col("place"))).join(registry, "key", "left")
    number = F.col("confidence").try_cast("double")
    bad = F.col("confidence").isNotNull() & (number.isNull() | ~number.between(0, 1))
    reason = F.coalesce(
        invalid_reason(["stream_id", "offset", "signal_type", "timestamp", "identity_hash"]),
        F.when(ms.isNull(), "invalid_timestamp").when(F.col("geography").isNull(), "unresolved_geography").when(F.col("level") != level, "geography_level_mismatch").when(bad, "invalid_confidence"))
    return x.select("stream_id", "offset", F.col("identity_hash").alias("id"), "signal_type", "geography", ms.alias("ts_ms"), F.when(~bad, number).alias("confidence"), reason.alias("reason"))


def canonical_domain(signal_type: Column, adapter: Column, override: Column) -> Column:
    """By override, adapter, words of the type; else civic."""
    known = F.create_map(*(F.lit(v) for pair in DOMAIN_OF_ADAPTER.items() for v in pair))
    words = F.lit("civic")
    for domain, ws in reversed(DOMAIN_WORDS.items()):
        words = F.when(F.lower(signal_type).rlike("|".join(ws)), F.lit(domain)).otherwise(words)
    return F.coalesce(override, F.try_element_at(known, F.regexp_replace(F.lower(adapter), "[^a-z]", "")), words)


def merged_rules(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A registry after an upsert: new values where given, old ones otherwise."""
    rest = [c for c in new.columns if c not in keys]
    x = old.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in rest)).join(new, keys, "full_outer")
    return x.select(*keys, *(F.coalesce(c, f"_o_{c}").alias(c) for c in rest))


def absent(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """rows not stored yet, one a key: for appends that ignore what is there."""
    return rows.dropDuplicates([key]).join(stored.select(key).distinct(), key, "left_anti")


def write_once(df: DataFrame, path: str, digest_col: str) -> str:
    """Writes df to path if nothing is there; if something is, its digests must be the same. Returns
    written or unchanged; raises on a conflict."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("errorifexists").parquet(path)
        return "written"
    total = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64(digest_col).cast("decimal(38,0)"))).first()
    if total(spark.read.parquet(path)) != total(df):
        raise ValueError(f"{path} holds another result")
    return "unchanged"


def projected_states(candidates: DataFrame) -> DataFrame:
    """candidates with the states that a receiving deployment knows; others become unresolved."""
    e = F.when(F.col("entity_state").isin("resolved", "ambiguous", "unresolved", "ignored"), F.col("entity_state")).otherwise("unresolved")
    v = F.when(F.col("verification_state").isin("supported_one_source", "supported_multiple_sources", "contradicted", "disputed", "incomplete", "unresolved", "verified"), F.col("verification_state")).otherwise("unresolved")
    return candidates.withColumn("projected_entity_state", e).withColumn("projected_verification_state", v)


def action_receipts(actions: DataFrame) -> DataFrame:
    """actions (actor, action, subject, at_ms) with a receipt id over all four."""
    return actions.withColumn("receipt_id", joined_hash(*map(F.col, ("actor", "action", "subject", "at_ms"))))


def entity_candidates(events: DataFrame, rules: dict[str, list[dict]], event: str = "event") -> DataFrame:
    """A row for each entity an event names. rules: stream -> list of role, type, names, ids (kind ->
    paths), many (path of an array of names). events: stream_id, offset, event (JSON). Events that no rule finds
    anything in give one row of role ignored. All rules run in one pass over the events."""
    none = F.lit(None).cast("string")
    fields = ("role", "expected_type", "place", "name", "id_kind", "id_value")
    row = lambda *values: F.struct(*(v.alias(n) for n, v in zip(fields, values)))
    made = []
    for stream, own in rules.items():
        here = F.col("stream_id") == stream
        for r in own:
            kind = value = none
            for k, paths in reversed(r.get("ids", {}).items()):
                v = at(event, *paths)
                kind, value = F.when(v.isNotNull(), F.lit(k)).otherwise(kind), F.coalesce(v, value)
            role, kinds = F.lit(r["role"]), F.lit(r["type"])
            made.append(F.when(here, F.array(row(role, kinds, F.lit(0), at(event, *r["names"]), kind, value))))
            if r.get("many"):
                listed = F.from_json(F.get_json_object(event, f"$.{r['many']}"), "array<string>")
                made.append(F.when(here, F.transform(listed, lambda n, i: row(role, kinds, i + 1, squeezed(n), none, none))))
    key = lambda x: F.concat_ws(chr(31), x["role"], F.coalesce(x["name"], F.lit(chr(0))), F.coalesce(x["id_value"], F.lit(chr(0))))
    nothing = F.array(row(F.lit("ignored"), F.lit("any"), F.lit(0), none, none, none))

    def once(found: Column) -> Column:
        """The first of each, or the one row that says there is none."""
        first = let(F.transform(found, key), lambda keys: F.filter(found, lambda x, i: F.array_position(keys, key(x)) == i + 1))
        return F.when(F.size(found) > 0, first).otherwise(nothing)

    named = F.filter(F.flatten(F.array_compact(F.array(*made))), lambda x: x["name"].isNotNull() | x["id_value"].isNotNull())
    return events.select("stream_id", "offset", F.inline(let(named, once)))
