"""Checks and small forms at the edges: requests, windows, record keys, lists in JSON, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import clamp, gaussian, half_up, haversine_km

# Where the parts of a source record's key are, first in the payload, then in the provenance and the raw record.
RECORD_KEY = ("payload.external_id", "payload.opportunity_number", "payload.pdf_url", "payload.source_url", "provenance.source_url", "payload.raw.id", "payload.raw.ein", "payload.raw.updated")


def source_record_key(event: Column) -> Column:
    """SHA-256 of where a record came from; what is missing counts as empty."""
    parts = [F.coalesce(F.get_json_object(event, f"$.{p}"), F.lit("")) for p in RECORD_KEY]
    return F.sha2(F.concat_ws("|", *parts), 256)


def json_list(text: Column) -> Column:
    """The texts of a JSON array; empty where it is none."""
    none = F.expr("cast(array() as array<string>)")
    return F.coalesce(F.when(F.trim(text).startswith("["), F.filter(F.from_json(text, "array<string>"), lambda x: x.isNotNull())), none)


def fixed(x: Column, places: int) -> Column:
    """A number as text with that many places, halves away from zero in decimal as it is written."""
    return F.format_string(f"%.{places}f", F.round(x.cast("decimal(38,12)"), places).cast("double"))


def concentration_text(subject: Column, n: Column, total: Column, z: Column) -> Column:
    """How a concentration is described: share to one place, z to two."""
    return F.concat(subject, F.lit(" holds "), n.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" observations ("), fixed(100 * n / total, 1), F.lit("%, z="), fixed(z, 2), F.lit(")"))


def temporal_similarity(a_ms: Column, b_ms: Column, most_ms: int) -> Column:
    """1 at the same time, 0 from ``most_ms`` on."""
    if most_ms <= 0:
        raise ValueError("the largest distance in time must be positive")
    return clamp(1 - F.abs(b_ms - a_ms) / F.lit(float(most_ms)), 0, 1)


def spatial_similarity(a: tuple[Column, Column], b: tuple[Column, Column], sigma_km: float) -> Column:
    """1 at the same place; null where a centroid is missing."""
    return gaussian(haversine_km(*a, *b), sigma_km)


def joint_similarity(a_ms: Column, b_ms: Column, a: tuple[Column, Column], b: tuple[Column, Column], most_ms: int, sigma_km: float) -> Column:
    """(temporal, spatial, joint), each to 12 places; spatial and joint are null where a centroid is missing."""
    t, s = temporal_similarity(a_ms, b_ms, most_ms), spatial_similarity(a, b, sigma_km)
    return F.struct(half_up(t, 12).alias("temporal"), half_up(s, 12).alias("spatial"), half_up(t * s, 12).alias("joint"))


def joint_similarities(a: DataFrame, b: DataFrame, group: str, most_ms: int, sigma_km: float, places: int = 6, salts: int = 32, tasks: int = 256) -> DataFrame:
    """a, b, temporal, spatial, joint of all pairs within a group, as by ``joint_similarity``, to ``places``. a: a,
    group, t1, y1, x1; b: b, group, t2, y2, x2.

    The spatial part is computed once for two places, not for each pair that lies there; a pair too far apart in
    time needs no arithmetic. Rows of b are given to each of ``salts`` parts of a group's rows of a, so a large group is
    shared by many tasks."""
    # a place as text: one key, exact, where nulls are equal and so are both zeros
    spot = lambda *cols: F.concat_ws("/", *(F.when(F.col(c) == 0, "0").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in cols))
    a, b = a.withColumn("p1", spot("y1", "x1")), b.withColumn("p2", spot("y2", "x2"))
    own, other = a.dropDuplicates([group, "p1"]).select(group, "p1", "y1", "x1"), b.dropDuplicates([group, "p2"]).select(group, "p2", "y2", "x2")
    s = spatial_similarity((F.col("y1"), F.col("x1")), (F.col("y2"), F.col("x2")), sigma_km)
    apart = own.join(other, group).select(group, "p1", "p2", s.alias("s"), F.round(half_up(s, 12), places).alias("spatial"))
    far = b.join(apart, [group, "p2"]).select(group, "p1", "b", "t2", "s", "spatial", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    near = a.select(group, "p1", "a", "t1", F.pmod(F.xxhash64("a", "t1"), F.lit(salts)).cast("int").alias("salt"))
    at = [group, "p1", "salt"]
    pairs = near.repartition(tasks, *at).join(far.repartition(tasks, *at), at)
    t = temporal_similarity(F.col("t1"), F.col("t2"), most_ms)
    late = F.abs(F.col("t2") - F.col("t1")) >= most_ms
    to = lambda x: F.round(half_up(x, 12), places)
    return pairs.select("a", "b", F.when(late, F.lit(0.0)).otherwise(to(t)).alias("temporal"), "spatial", F.when(F.col("s").isNull(), F.lit(None).cast("double")).when(late, F.lit(0.0)).otherwise(to(t * F.col("s"))).alias("joint"))


def window_error(start: Column, end: Column, as_of: Column) -> Column:
    """Why a window of written times is none: a bound is missing or no time, or they are out of order; null if
    nothing is wrong."""
    ms = lambda x: F.unix_millis(F.try_to_timestamp(x))
    a, b, c = ms(start), ms(end), ms(as_of)
    return F.when(a.isNull(), "missing_from").when(b.isNull(), "missing_to").when(c.isNull(), "missing_as_of").when(a > b, "from_exceeds_to").when(b > c, "to_exceeds_as_of")


def window_length(start: Column, end: Column) -> Column:
    ms = lambda x: F.unix_millis(F.try_to_timestamp(x))
    return ms(end) - ms(start)


def _type(body: Column, path: str) -> Column:
    """The JSON type at a path of a variant; null where nothing is."""
    return F.schema_of_variant(F.try_variant_get(body, path, "variant"))


def request_errors(body: Column, kind: str) -> Column:
    """What is wrong with the body of a request, as JSON text: ingest, cursor or investigation. Names of errors in
    the order of the fields, joined by commas; empty if the body is fine."""
    v = F.try_parse_json(body)
    text = lambda p: F.coalesce(_type(v, p) == "STRING", F.lit(False)) & (F.coalesce(F.try_variant_get(v, p, "string"), F.lit("")) != "")
    there = lambda p: F.coalesce(_type(v, p) != "VOID", F.lit(False))
    whole = lambda p: F.coalesce(_type(v, p) == "BIGINT", F.lit(False))
    ordered = F.coalesce(F.try_variant_get(v, "$.trigger.to_offset", "long") < F.try_variant_get(v, "$.trigger.from_offset", "long"), F.lit(False))
    rules = {
        "ingest": [("source_id", ~text("$.source_id")), ("jurisdiction_id", ~text("$.jurisdiction_id")), ("module_hint", ~text("$.module_hint")), ("signals", ~F.coalesce(_type(v, "$.signals").startswith("ARRAY"), F.lit(False)))],
        "cursor": [("name", ~text("$.name")), ("from_offset", there("$.from_offset") & ~whole("$.from_offset")), ("from_timestamp", there("$.from_timestamp") & F.try_to_timestamp(F.try_variant_get(v, "$.from_timestamp", "string")).isNull())],
        "investigation": [("trigger", ~F.coalesce(_type(v, "$.trigger").startswith("OBJECT"), F.lit(False))), ("stream_id", ~text("$.trigger.stream_id")), ("from_offset", ~whole("$.trigger.from_offset")), ("to_offset", ~whole("$.trigger.to_offset")), ("order", whole("$.trigger.from_offset") & whole("$.trigger.to_offset") & ordered)],
    }[kind]
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.array_join(F.array_compact(F.array(F.when(~is_object, F.lit("body")), *(F.when(bad, F.lit(name)) for name, bad in rules))), ",")


