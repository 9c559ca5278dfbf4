"""What is written down: resolutions that pass every check, upserts of registries and signals, ingest that
stops at a failing row, exports, run bundles. Checks give a reason for each row; a batch with any reason
is refused as a whole where its contract says so."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import entity_key, identifier_key, squeezed
from ..storage import cut
from ..tables import joined_hash
from .readmodels import keep_newest

# The states and methods that a resolution may have, and the types of civic signals.
STATUSES = ("resolved", "ambiguous", "unresolved", "ignored")
CIVIC_TYPES = ("new_statute_or_bill", "jurisdiction_legislative_activity", "classification_activity")
SHA256 = "^[0-9a-f]{64}$"


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check whose condition of failure holds; null where none does."""
    return F.get(F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in checks))), F.lit(0))


# --- resolutions ---


def candidate_key(*columns: str) -> Column:
    return joined_hash(*map(F.col, columns))


KEY_FIELDS = ("rule_id", "rule_version", "entity_role", "source_field", "normalized_name", "id_field", "id_kind", "normalized_id", "expected_type")
HASH_FIELDS = ("event_hash", "index_hash", "manifest_hash", "candidate_key", "status", "method", "entity_id", "candidates_text")


def resolution_hash() -> Column:
    return joined_hash(*map(F.col, HASH_FIELDS))


def checked_resolutions(rows: DataFrame, events: DataFrame, rules: DataFrame, entities: DataFrame, expected: DataFrame, manifest_hash: str, index_hash: str) -> DataFrame:
    """rows with ``reason``: the first of the checks that a row fails.

    rows: stream_id, offset, event_hash, rule_id, rule_version, entity_role, expected_type, source_field,
    source_value, normalized_name, id_field, id_kind, id_value, normalized_id, candidate_key, status, method,
    entity_id, candidates (array), manifest_hash, index_hash, resolution_hash; events: stream_id, offset,
    signal_type, event_hash, fields (map of path to text); rules: rule_id, rule_version, stream_id, signal_types
    (array), entity_role, expected_type, name_fields, id_fields, id_kinds (arrays), ignores; entities: entity_id
    that are active; expected: candidate_key, want_status, want_method, want_entity, want_candidates, what
    resolving again gives.

    Rows meet events and rules in equality joins; candidates are counted against the registry apart."""
    ev = events.select("stream_id", "offset", F.col("signal_type").alias("_signal"), F.col("event_hash").alias("_event_hash"), F.col("fields").alias("_fields"))
    rule = rules.select("rule_id", "rule_version", F.col("stream_id").alias("_stream"), F.col("signal_types").alias("_signals"), F.col("entity_role").alias("_role"), F.col("expected_type").alias("_type"), F.col("name_fields").alias("_names"), F.col("id_fields").alias("_ids"), F.col("id_kinds").alias("_kinds"), F.col("ignores").alias("_ignores"))
    numbered = rows.withColumn("_row", joined_hash(*(F.col(c).cast("string") for c in ("stream_id", "offset", "rule_id", "rule_version", "candidate_key", "resolution_hash"))))
    live = entities.select(F.col("entity_id").alias("_c"), F.lit(1).alias("_live"))
    unknown = numbered.select("_row", F.explode("candidates").alias("_c")).distinct().join(live, "_c", "left").where("_live is null").select("_row").distinct().withColumn("_unknown", F.lit(True))
    x = numbered.join(ev, ["stream_id", "offset"], "left").join(rule, ["rule_id", "rule_version"], "left").join(unknown, "_row", "left").join(expected.dropDuplicates(["candidate_key"]), "candidate_key", "left")
    x = x.withColumn("candidates_text", F.array_join(F.array_sort("candidates"), ","))
    missing = lambda c: squeezed(F.col(c)).isNull()
    differs = lambda a, b: ~a.eqNullSafe(b)
    none = F.col("source_field") == "__none__"
    has = F.col("id_field").isNotNull()
    checks = [
        ("missing_identity", reduce(lambda a, b: a | b, map(missing, ("stream_id", "rule_id", "rule_version", "entity_role", "source_field")))),
        ("invalid_hash", ~F.col("candidate_key").rlike(SHA256) | ~F.col("resolution_hash").rlike(SHA256)),
        ("input_state_mismatch", differs(F.col("manifest_hash"), F.lit(manifest_hash)) | differs(F.col("index_hash"), F.lit(index_hash))),
        ("invalid_status", ~F.col("status").isin(*STATUSES) | F.col("status").isNull()),
        ("missing_method", missing("method")),
        ("resolved_without_entity", (F.col("status") == "resolved") & F.col("entity_id").isNull()),
        ("entity_without_resolution", (F.col("status") != "resolved") & F.col("entity_id").isNotNull()),
        ("unknown_event", F.col("_event_hash").isNull()),
        ("unknown_rule", F.col("_role").isNull()),
        ("rule_of_other_stream", ~F.col("_stream").isin("*") & (F.col("_stream") != F.col("stream_id"))),
        ("rule_of_other_type", ~F.array_contains("_signals", "*") & ~F.array_contains("_signals", F.col("_signal"))),
        ("role_mismatch", differs(F.col("entity_role"), F.col("_role"))),
        ("type_mismatch", differs(F.col("expected_type"), F.col("_type"))),
        ("field_not_allowed", ~none & ~F.array_contains("_names", F.col("source_field"))),
        ("field_without_value", ~none & F.col("source_value").isNull()),
        ("value_without_field", none & F.col("source_value").isNotNull()),
        ("identifier_field_not_allowed", has & ~F.array_contains("_ids", F.col("id_field"))),
        ("identifier_kind_not_allowed", F.col("id_kind").isNotNull() & ~F.array_contains("_kinds", F.col("id_kind"))),
        ("identifier_without_field", ~has & F.col("id_value").isNotNull()),
        ("identifier_without_kind", has & F.col("id_kind").isNull()),
        ("identifier_field_without_value", has & F.col("id_value").isNull()),
        ("fuzzy_method", F.lower("method").contains("fuzzy")),
        ("not_ignored", F.col("_ignores") & (F.col("status") != "ignored")),
        ("ignored_by_other_rule", ~F.col("_ignores") & (F.col("status") == "ignored")),
        ("event_hash_mismatch", differs(F.col("event_hash"), F.col("_event_hash"))),
        ("source_value_mismatch", ~none & differs(F.try_element_at("_fields", F.col("source_field")), F.col("source_value"))),
        ("normalized_name_mismatch", differs(entity_key(squeezed(F.col("source_value"))), F.col("normalized_name"))),
        ("identifier_value_mismatch", has & differs(F.try_element_at("_fields", F.col("id_field")), F.col("id_value"))),
        ("normalized_identifier_mismatch", differs(F.when(has, identifier_key(F.col("id_kind"), F.col("id_value"))), F.col("normalized_id"))),
        ("candidate_key_mismatch", differs(candidate_key(*KEY_FIELDS), F.col("candidate_key"))),
        ("too_few_candidates", (F.col("status") == "ambiguous") & (F.size(F.array_distinct("candidates")) < 2)),
        ("entity_not_a_candidate", (F.col("status") == "resolved") & ~F.array_contains("candidates", F.col("entity_id"))),
        ("inactive_candidate", F.coalesce("_unknown", F.lit(False))),
        ("not_reproduced", ~F.col("_ignores") & (differs(F.col("status"), F.col("want_status")) | differs(F.col("method"), F.col("want_method")) | differs(F.col("entity_id"), F.col("want_entity")) | differs(F.array_sort("candidates"), F.array_sort("want_candidates")))),
        ("resolution_hash_mismatch", differs(resolution_hash(), F.col("resolution_hash"))),
    ]
    return x.withColumn("reason", first_reason(checks)).select(*rows.columns, "reason")


def persisted_resolutions(checked: DataFrame, stored: DataFrame, most: int = 10_000) -> DataFrame:
    """stored after a batch: rows of the batch become current, others of their events and keys step down,
    what was stored stays. Refused as a whole if any row has a reason or there are more than ``most`` rows (its
    contract's bound: nothing is cut). stored: as checked, with is_current."""
    checked = cut(checked)  # it is read for the verdict and again for the rows
    seen = checked.agg(F.count("*").alias("n"), F.count("reason").alias("bad"), F.min("reason").alias("why")).first()
    if seen["n"] > most:
        raise ValueError(f"a batch holds at most {most} resolutions, not {seen['n']}")
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} resolutions fail, as {seen['why']}")
    key = ["stream_id", "offset", "candidate_key"]
    new = checked.drop("reason").dropDuplicates([*key, "resolution_hash"])
    again = new.select(*key, "resolution_hash").withColumn("_again", F.lit(True))
    touched = new.select(*key).distinct().withColumn("_touched", F.lit(True))
    old = stored.join(again, [*key, "resolution_hash"], "left").join(touched, key, "left")
    old = old.withColumn("is_current", F.when(F.col("_again"), F.lit(True)).when(F.col("_touched"), F.lit(False)).otherwise(F.col("is_current"))).select(*stored.columns)
    fresh = new.join(stored.select(*key, "resolution_hash"), [*key, "resolution_hash"], "left_anti").withColumn("is_current", F.lit(True))
    return old.unionByName(fresh.select(*stored.columns))


def run_ledger(starts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """A row for each started run (run_id, started_ms, batch_size, rule_count): valid ones with counts of what
    they persisted by status and whether they are complete; others refused with a reason. resolutions: run_id,
    status, stream_id, offset."""
    reason = first_reason([("missing_run_id", squeezed(F.col("run_id")).isNull()), ("invalid_batch_size", ~F.col("batch_size").between(1, 5000) | F.col("batch_size").isNull()), ("no_rules", (F.col("rule_count") < 1) | F.col("rule_count").isNull())])
    counts = resolutions.groupBy("run_id").agg(F.count("*").alias("rows"), F.count_distinct("stream_id", "offset").alias("events"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))
    x = starts.withColumn("reason", reason).join(counts, "run_id", "left").na.fill(0, ["rows", "events", *STATUSES])
    state = F.when(F.col("reason").isNotNull(), "refused").when(F.col("rows") > 0, "completed").otherwise("started")
    return x.withColumn("state", state)


def review_queue(resolutions: DataFrame, keys: list[str], status: str | None = None, least: int = 1, most: int = 100) -> DataFrame:
    """The largest groups of alike resolutions that need a reviewer (a report: ``most`` is its point, 1 to
    5,000): by events, streams, latest event and key. resolutions: status, stream_id, offset, ts_ms and keys."""
    open_ = ("ambiguous", "unresolved")
    x = resolutions.where(F.col("status").isin(*(open_ if status is None else [s for s in open_ if s == status])))
    g = x.groupBy("status", *keys).agg(F.count_distinct("stream_id", "offset").alias("events"), F.count_distinct("stream_id").alias("streams"), F.array_join(F.array_sort(F.collect_set("stream_id")), ",").alias("stream_ids"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    g = g.withColumn("review_key", joined_hash(F.col("status"), *map(F.col, keys))).where(F.col("events") >= max(1, least))
    return g.orderBy(F.desc("events"), F.desc("streams"), F.desc("last_ms"), "review_key").limit(max(1, min(most, 5000)))


def candidate_union(*lists: str) -> Column:
    """The sorted distinct members of array columns, nulls counting as empty."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_sort(F.array_distinct(F.concat(*(F.coalesce(F.col(c), none) for c in lists))))


def identity_best(rows: DataFrame) -> DataFrame:
    """One row an entity and input: the highest rate, then the most records, then the first name."""
    w = W.partitionBy("entity_id", "input_hash").orderBy(F.desc("rate"), F.desc("records"), "primary_name", "normalized_name")
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


# --- registries and signals ---


def registry_upsert(stored: DataFrame, records: DataFrame, order: str = "place") -> DataFrame:
    """stored after an upsert of records: those with id, type and name that a deterministic mapping made;
    the last of an id by ``order`` wins and replaces every value. Others change nothing. Both: entity_id,
    entity_type, primary_name, jurisdiction_count, is_active; records also extraction_method and order."""
    good = records.where("entity_id is not null and entity_type is not null and primary_name is not null and extraction_method = 'deterministic_field_mapping'")
    good = keep_newest(good.withColumn("jurisdiction_count", F.coalesce("jurisdiction_count", F.lit(0))).withColumn("is_active", F.coalesce("is_active", F.lit(True))), ["entity_id"], order, "primary_name")
    return stored.join(good.select("entity_id"), "entity_id", "left_anti").unionByName(good.select(*stored.columns))


SIGNAL_KEY = ["connector_id", "signal_type", "statute_id", "rule_id"]


def civic_signals(records: DataFrame) -> DataFrame:
    """records with ``reason``: the first thing that keeps a signal out. A batch with any reason is refused."""
    missing = lambda c: (f"missing_{c}", squeezed(F.col(c).cast("string")).isNull())
    return records.withColumn("reason", first_reason([("not_deterministic", ~F.col("generation_method").eqNullSafe(F.lit("deterministic_rule"))), *map(missing, ("source_url", "raw_record_id", "statute_id", "connector_id", "rule_id")), ("type_not_allowed", ~F.col("signal_type").isin(*CIVIC_TYPES) | F.col("signal_type").isNull())]))


def civic_upsert(stored: DataFrame, checked: DataFrame, order: str = "place") -> DataFrame:
    """stored after an upsert of checked signals by SIGNAL_KEY; later ones of a batch win; the first time and
    the geography of a stored signal stay."""
    bad = checked.agg(F.count("reason").alias("n"), F.min("reason").alias("why")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} signals fail, as {bad['why']}")
    new = keep_newest(checked, SIGNAL_KEY, order, "raw_record_id")
    kept = ["geography_key"]
    x = stored.select(*SIGNAL_KEY, *(F.col(c).alias(f"_o_{c}") for c in stored.columns if c not in SIGNAL_KEY), F.lit(True).alias("_old")).join(new.select(*stored.columns, F.lit(True).alias("_new")), SIGNAL_KEY, "full_outer")
    value = lambda c: F.when(F.col("_old") & (F.col("_new").isNull() | F.lit(c in kept)), F.col(f"_o_{c}")).otherwise(F.col(c)).alias(c)
    return x.select(*SIGNAL_KEY, *(value(c) for c in stored.columns if c not in SIGNAL_KEY))


# --- ingest ---

INGEST_FIELDS = ("stream_id", "timestamp", "signal_type", "source_id", "jurisdiction_id", "module_hint")


def batch_outcome(batch: DataFrame, known: DataFrame, receipts: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A replay-safe append of batches that each stop at their first failing row: (rows with outcome and offset,
    a row a batch, its first receipts). batch: batch_id, place (1 on), INGEST_FIELDS, identity_hash; known:
    stream_id, identity_hash, canonical_offset. A batch holds one stream; one with several is refused.

    Within a batch the first row of a new content is inserted, later ones are replays; offsets go on from the
    stream's last. Batches of one stream are taken in order of their ids."""
    missing = reduce(lambda a, b: a | b, (squeezed(F.col(c).cast("string")).isNull() for c in INGEST_FIELDS)) | F.col("identity_hash").isNull()
    per = batch.groupBy("batch_id").agg(F.min(F.when(missing, F.col("place"))).alias("_stop"), F.count_distinct("stream_id").alias("_streams"), F.count("*").alias("seen"))
    x = batch.join(per, "batch_id")
    done = F.when(F.col("_streams") > 1, "refused").when(F.col("place") == F.col("_stop"), "failed").when(F.col("place") > F.col("_stop"), "not_reached")
    x = x.withColumn("_state", done)
    live = x.where("_state is null")
    first = live.groupBy("stream_id", "identity_hash").agg(F.min(F.struct("batch_id", "place")).alias("_first")).join(known, ["stream_id", "identity_hash"], "left")
    # new contents are numbered by the order of their batches: counts a batch first, then places within one
    new = first.where("canonical_offset is null").select("stream_id", "identity_hash", F.col("_first.batch_id").alias("_b"), F.col("_first.place").alias("_p"))
    before = new.groupBy("stream_id", "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("stream_id").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    start = known.groupBy("stream_id").agg((F.max("canonical_offset") + 1).alias("_start"))
    new = new.join(before, ["stream_id", "_b"]).join(start, "stream_id", "left")
    new = new.select("stream_id", "identity_hash", (F.coalesce("_start", F.lit(0)) + F.col("_before") + F.row_number().over(W.partitionBy("stream_id", "_b").orderBy("_p")) - 1).alias("_new"))
    first = first.join(new, ["stream_id", "identity_hash"], "left")
    x = x.join(first, ["stream_id", "identity_hash"], "left")
    here = (F.col("_first.batch_id") == F.col("batch_id")) & (F.col("_first.place") == F.col("place")) & F.col("canonical_offset").isNull()
    x = x.withColumn("outcome", F.coalesce("_state", F.when(here, "inserted").otherwise("replayed"))).withColumn("offset", F.when(F.col("_state").isNull(), F.coalesce("canonical_offset", "_new")))
    rows = x.select("batch_id", "place", "stream_id", "identity_hash", "outcome", "offset")
    count = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    runs = rows.groupBy("batch_id").agg(F.count("*").alias("seen"), *map(count, ("inserted", "replayed", "failed", "not_reached", "refused")), F.max("offset").alias("cursor_after"))
    status = F.when(F.col("refused") > 0, "refused").when(F.col("failed") == 0, "completed").when(F.col("inserted") + F.col("replayed") > 0, "partial").otherwise("failed")
    told = rows.where(F.col("outcome").isin("inserted", "replayed")).withColumn("_i", F.row_number().over(W.partitionBy("batch_id").orderBy("place"))).where(F.col("_i") <= receipts).drop("_i")
    return rows, runs.withColumn("status", status), told


# --- exports and catalogs ---


def export_page(ledger: DataFrame, events: DataFrame, allowed: DataFrame, stream_id: str, offset: int = 0, limit: int = 1000) -> DataFrame:
    """A page of a stream's canonical events from an offset on, if the stream may be exported (a page of 1 to
    1,000 rows is the contract). ledger: stream_id, canonical_offset, last_seen_ms; allowed: stream_id, enabled."""
    canonical = ledger.where((F.col("stream_id") == stream_id) & (F.col("canonical_offset") >= max(0, offset))).select("stream_id", F.col("canonical_offset").alias("offset"), F.col("last_seen_ms").alias("ingested_ms"))
    page = events.drop("ingested_ms").join(canonical, ["stream_id", "offset"]).join(allowed.where("enabled").select("stream_id").distinct(), "stream_id", "left_semi")
    return page.orderBy("offset").limit(min(max(limit, 1), 1000))


def exported(ledger: DataFrame, events: DataFrame, allowed: DataFrame) -> DataFrame:
    """All canonical events of all streams that may be exported."""
    streams = allowed.where("enabled").select("stream_id").distinct()
    canonical = ledger.join(streams, "stream_id", "left_semi").select("stream_id", F.col("canonical_offset").alias("offset"), F.col("last_seen_ms").alias("ingested_ms"))
    return events.drop("ingested_ms").join(canonical, ["stream_id", "offset"])


PUBLIC = ("stream_id", "offset", "timestamp", "signal_type", "spacetime", "provenance", "payload")


def public_events(events: DataFrame) -> DataFrame:
    """Only what readers outside may see of events."""
    return events.select(*PUBLIC)


def prime_patterns(patterns: DataFrame, module: str | None = None, jurisdiction: str | None = None, since_ms: int | None = None, most: int = 1000) -> DataFrame:
    """The newest patterns (a report of at most ``most``), by module, jurisdiction and time."""
    x = patterns
    for column, value in (("module", module), ("jurisdiction", jurisdiction)):
        x = x if value is None else x.where(F.col(column) == value)
    x = x if since_ms is None else x.where(F.col("detected_ms") >= since_ms)
    return x.orderBy(F.desc("detected_ms"), "pattern_id").limit(most)


def catalog_summary(streams: DataFrame, *groups: str) -> DataFrame:
    """group, name, n of a catalog; a missing value counts as unknown."""
    pairs = F.array(*(F.struct(F.lit(g).alias("group"), F.coalesce(F.col(g).cast("string"), F.lit("unknown")).alias("name")) for g in groups))
    return streams.select(F.inline(pairs)).groupBy("group", "name").agg(F.count("*").alias("n")).union(streams.agg(F.count("*").alias("n")).select(F.lit("total"), F.lit("streams"), "n"))


def whole(view: DataFrame, most: int = 1_000_000) -> DataFrame:
    """view, or an error where it holds more rows than an index may: it is never cut."""
    n = view.count()
    if n > most:
        raise ValueError(f"{n} rows, more than {most}: an index is not cut")
    return view


# --- bundles and snapshots ---


def run_bundle(manifests: DataFrame, receipts: DataFrame) -> DataFrame:
    """run_key, manifest and receipts of each run as JSON, receipts in order of geography; the time of writing is
    in neither. manifests: run_key and others; receipts: run_key, geography and others."""
    strip = lambda df: [c for c in df.columns if c != "persisted_ms"]
    rest = [c for c in strip(receipts) if c != "run_key"]
    each = receipts.groupBy("run_key").agg(F.array_sort(F.collect_list(F.struct("geography", *(c for c in rest if c != "geography")))).alias("_r"))
    x = manifests.join(each, "run_key", "left")
    none = F.expr("'[]'")
    return x.select("run_key", F.to_json(F.struct(*strip(manifests))).alias("manifest"), F.coalesce(F.to_json("_r"), none).alias("receipts"))


def traits_by_run(versions: DataFrame, traits: DataFrame, sep: str | None = None) -> DataFrame:
    """versions (version_key, run_id) with the traits (trait_id, run_id) that their extraction run made, in order; with
    ``sep`` as text, which is made once for a run and not for each of its versions."""
    made = traits.where("run_id is not null").groupBy("run_id").agg(F.array_sort(F.collect_list("trait_id")).alias("traits"))
    none = F.array().cast("array<long>")
    if sep is not None:
        made, none = made.withColumn("traits", F.array_join(F.col("traits").cast("array<string>"), sep)), F.lit("")
    return versions.join(made, "run_id", "left").withColumn("traits", F.coalesce("traits", none))


def runtime_snapshot(streams: DataFrame, adapters: DataFrame, receipts: DataFrame) -> DataFrame:
    """streams with their adapter, if any (stream_id, adapter, priority, interval_ms), and the latest receipt
    of a run (target_id, outcome, completed_ms, error)."""
    last = receipts.where("target_id is not null").groupBy(F.col("target_id").alias("stream_id")).agg(F.max(F.struct("completed_ms", "outcome", "error")).alias("_l"))
    x = streams.join(adapters, "stream_id", "left").join(last, "stream_id", "left")
    return x.select(*streams.columns, F.col("adapter").isNotNull().alias("runnable"), "adapter", "priority", F.round(F.col("interval_ms") / 3_600_000).cast("long").alias("interval_hours"), F.col("_l.outcome").alias("last_outcome"), F.col("_l.completed_ms").alias("last_run_ms"), F.col("_l.error").alias("last_error"))


def reconciled(health: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: jobs seen, receipts made, new ones and those already there. health: job_id, receipt_hash;
    stored: receipt_hash."""
    known = stored.select("receipt_hash").distinct().withColumn("_k", F.lit(True))
    x = health.join(known, "receipt_hash", "left")
    return x.agg(F.count_distinct("job_id").alias("jobs_seen"), F.count("*").alias("receipts_processed"), F.count_if(F.col("_k").isNull()).alias("persisted_count"), F.count("_k").alias("idempotent_count"))


def bridge_totals(receipts: DataFrame, errors: DataFrame) -> DataFrame:
    """run_id and what its bridge receipts add up to; errors (run_id) count as failed."""
    sums = receipts.groupBy("run_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("candidates_seen", "bridged", "idempotent", "failed")), F.count("*").alias("receipts"))
    wrong = errors.groupBy("run_id").agg(F.count("*").alias("_e"))
    x = sums.join(wrong, "run_id", "full_outer").na.fill(0)
    return x.withColumn("failed", F.col("failed") + F.col("_e")).drop("_e")
