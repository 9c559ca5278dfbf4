"""What events declare: entities with exact identifiers, transfers, legislative actions, assertions, numbers.

An event's JSON is parsed once into a variant; every field is looked for where a source may have put it, the
declared observation first, then the payload, then the raw record. Rows that lack what a detector needs are
not rows of the view: nothing is guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import comparable, squeezed, stable_id

# The kinds and signal types that each view reads.
ENTITY_KINDS, ENTITY_SIGNALS = ("entity", "entity_registration", "license"), ("entity_registration", "license")
TRANSFER_KINDS, TRANSFER_SIGNALS = ("financial_transfer", "campaign_contribution", "lobbying_disclosure"), ("campaign_contribution", "campaign_disbursement", "lobbying_disclosure", "financial_transfer")
ACTION_KINDS = ("legislative_action", "legislative_activity")
ASSERTION_KINDS = ("assertion", "source_assertion", "enforcement_assertion")
NUMBER_KINDS = ("numeric_observation", "declared_numeric_range")
_DECLARED, _RAW = "payload.integrity_observation", "payload.raw"


def parsed(events: DataFrame, event: str = "event") -> DataFrame:
    """events (stream_id, offset, event as JSON) with the variant that the views read; what is no JSON object
    declares nothing."""
    return events.withColumn("_v", F.try_parse_json(event))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("_v", f"$.{path}", kind)


def _first(xs, form) -> Column:
    """The first of xs that is something in the given form. One expression over an array, so that generated
    code stays small."""
    return F.get(F.filter(F.transform(F.array(*xs), form), lambda x: x.isNotNull()), F.lit(0))


def _text(declared: str = "", payload: str = "", raw: str = "", more: tuple[str, ...] = ()) -> list[Column]:
    """Where a text may be: names separated by blanks, in order of preference."""
    return [_get(f"{at}.{n}") for at, names in ((_DECLARED, declared), ("payload", payload), (_RAW, raw)) for n in names.split()] + [_get(p) for p in more]


def _id(*keys: str) -> Column:
    """The first stable id under any of keys, each looked for in all three places before the next."""
    return _first([_get(f"{at}.{k}") for k in keys for at in (_DECLARED, "payload", _RAW)], stable_id)


def _own_id(*paths: str) -> Column:
    return _first([*map(_get, paths), F.concat_ws(":", "stream_id", F.col("offset").cast("string"))], stable_id)


def _kind() -> Column:
    return comparable(_get(f"{_DECLARED}.kind"))


def _signal() -> Column:
    return comparable(_get("signal_type"))


def _list(*paths: str) -> Column:
    """The list at the first of paths that holds anything: an array, or a text of parts."""
    there = lambda p: F.coalesce(_get(p, "array<string>"), F.split(_get(p), "[,;|]"))
    found = F.coalesce(*map(there, paths), F.expr("cast(array() as array<string>)"))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(found, comparable))))


def _place() -> Column:
    return _first([_get(f"{_DECLARED}.jurisdiction_id"), _get("jurisdiction_id"), _get("spacetime.jurisdiction"), _get("spacetime.region"), F.lit("unknown")], squeezed)


def _number(name: str) -> Column:
    """A finite number that may be written as text."""
    x = F.coalesce(*(_get(f"{at}.{name}", "double") for at in (_DECLARED, "payload", _RAW)))
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _when(declared: str, payload: str = "", raw: str = "") -> Column:
    return _first(_text(declared, payload, raw, ("timestamp", "ingested_at")), squeezed)


def instant(text: Column) -> Column:
    """Milliseconds of a written time, null if it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def identifiers(events: DataFrame) -> DataFrame:
    """stream_id, offset, kind, value: the exact identifiers that events declare, in comparable form, once
    each. events: as ``parsed`` gives them."""
    held = F.coalesce(*(_get(f"{at}.exact_identifiers", "map<string,variant>") for at in (_DECLARED, "payload", _RAW)))
    x = events.select("stream_id", "offset", F.explode(held).alias("kind", "_value"))
    values = F.coalesce(F.try_variant_get("_value", "$", "array<string>"), F.array(F.try_variant_get("_value", "$", "string")))
    x = x.select("stream_id", "offset", comparable(F.col("kind")).alias("kind"), F.explode(values).alias("value")).withColumn("value", comparable(F.col("value")))
    return x.where("kind is not null and value is not null").distinct()


def entities(events: DataFrame) -> DataFrame:
    """Events that register an entity, or that carry exact identifiers of one."""
    has_ids = F.coalesce(*(F.map_keys(_get(f"{at}.exact_identifiers", "map<string,variant>")) for at in (_DECLARED, "payload", _RAW)))
    entity = _id("canonical_entity_id", "entity_id")
    x = events.select(
        "stream_id", "offset", entity.alias("entity_id"), _first([*_text("entity_name", "entity_name organization_name registrant_name", "name"), entity], squeezed).alias("label"), _first(_text("status", "status", "status"), squeezed).alias("status"),
        _when("formed_at", "formed_at registration_date", "formed_at").alias("formed_at"), _first(_text("ended_at", "ended_at termination_date", "ended_at"), squeezed).alias("ended_at"), _place().alias("jurisdiction_id"),
        _list(f"{_DECLARED}.interest_tags", "payload.interest_tags", f"{_RAW}.interest_tags").alias("interest_tags"), (_kind().isin(*ENTITY_KINDS) | _signal().isin(*ENTITY_SIGNALS)).alias("_own"), F.size(has_ids).alias("_ids"))
    return x.where(F.col("entity_id").isNotNull() & (F.coalesce("_own", F.lit(False)) | (F.col("_ids") > 0))).drop("_own", "_ids")


def transfers(events: DataFrame) -> DataFrame:
    """Events that move money between two known parties."""
    source = _id("from_canonical_entity_id", "from_entity_id", "payer_entity_id", "donor_entity_id", "client_entity_id")
    target = _id("to_canonical_entity_id", "to_entity_id", "recipient_entity_id", "candidate_entity_id", "registrant_entity_id")
    x = events.where(F.coalesce(_kind().isin(*TRANSFER_KINDS), F.lit(False)) | F.coalesce(_signal().isin(*TRANSFER_SIGNALS), F.lit(False))).select(
        "stream_id", "offset", _own_id(f"{_DECLARED}.transfer_id", "payload.transfer_id", "payload.external_id", "payload.filing_id").alias("transfer_id"), source.alias("from_id"), target.alias("to_id"),
        _first([*_text("from_entity_name", "from_entity_name donor_name client_name"), source], squeezed).alias("from_label"), _first([*_text("to_entity_name", "to_entity_name recipient_name candidate_name registrant_name"), target], squeezed).alias("to_label"),
        _number("amount").alias("amount"), instant(_when("occurred_at", "occurred_at filing_date date", "date")).alias("ts_ms"),
        _list(f"{_DECLARED}.purpose_tags", f"{_DECLARED}.policy_tags", "payload.purpose_tags", "payload.issues", f"{_RAW}.purpose_tags").alias("tags"), _place().alias("jurisdiction_id"))
    return x.where("from_id is not null and to_id is not null and amount > 0 and ts_ms is not null")


def actions(events: DataFrame) -> DataFrame:
    """Legislative actions of known actors on declared policies."""
    actor = _id("actor_canonical_entity_id", "actor_entity_id", "legislator_entity_id")
    x = events.where(F.coalesce(_kind().isin(*ACTION_KINDS), F.lit(False)) | F.coalesce(_signal().isin(*ACTION_KINDS), F.lit(False))).select(
        "stream_id", "offset", _own_id(f"{_DECLARED}.action_id", "payload.action_id", "payload.external_id", f"{_RAW}.id").alias("action_id"), actor.alias("actor_id"), _first([*_text("actor_name", "actor_name legislator_name"), actor], squeezed).alias("actor_label"),
        instant(_when("occurred_at", "occurred_at latest_action_date", "latest_action_date")).alias("ts_ms"), _list(f"{_DECLARED}.policy_tags", "payload.policy_tags", "payload.subjects", f"{_RAW}.subject").alias("tags"), _place().alias("jurisdiction_id"))
    return x.where("actor_id is not null and action_id is not null and size(tags) > 0 and ts_ms is not null")


def assertions(events: DataFrame) -> DataFrame:
    """What sources assert of subjects."""
    subject = _id("subject_canonical_entity_id", "subject_id", "entity_id")
    x = events.where(_kind().isin(*ASSERTION_KINDS)).select(
        "stream_id", "offset", _own_id(f"{_DECLARED}.assertion_id", "payload.assertion_id", "payload.external_id").alias("assertion_id"), subject.alias("subject"), _first([*_text("subject_name", "subject_name"), subject], squeezed).alias("subject_label"),
        comparable(F.coalesce(*_text("predicate", "predicate", "predicate"))).alias("predicate"), squeezed(F.coalesce(*_text("value", "value", "value"))).alias("value"), _place().alias("jurisdiction_id"),
        _first([_get("source_id"), _get("provenance.source_system"), F.col("stream_id")], squeezed).alias("source"))
    return x.where("subject is not null and predicate is not null and value is not null")


def numbers(events: DataFrame) -> DataFrame:
    """Numbers that sources declare with at least one bound."""
    subject = _id("subject_canonical_entity_id", "subject_id", "entity_id")
    x = events.where(_kind().isin(*NUMBER_KINDS)).select(
        "stream_id", "offset", _own_id(f"{_DECLARED}.observation_id", "payload.observation_id", "payload.external_id").alias("observation_id"), subject.alias("subject"), comparable(F.coalesce(*_text("metric", "metric", "metric"))).alias("metric"),
        _number("actual").alias("actual"), _number("expected_min").alias("least"), _number("expected_max").alias("most"), _place().alias("jurisdiction_id"))
    return x.where("subject is not null and metric is not null and actual is not null and (least is not null or most is not null)")
