"""Read models: summaries that join a dimension to what was counted about it.

Facts are aggregated before they meet a dimension, so a join carries a row a key and never a fact table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dimension_summary(dim: DataFrame, facts: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """dim with aggregates of facts by key; counts of what is absent are 0, other aggregates null."""
    got = facts.groupBy(key).agg(F.count("*").alias("n"), *(c.alias(k) for k, c in aggs.items()))
    return dim.join(got, key, "left").na.fill(0, ["n"])


def unique_lookup(rows: DataFrame, registry: DataFrame, key: str, value: str) -> DataFrame:
    """rows with value where exactly one row of registry has the key, null otherwise, and match_count."""
    once = registry.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("match_count"), F.min(value).alias("_v"))
    x = rows.join(once, key, "left").na.fill(0, ["match_count"])
    return x.withColumn(value, F.when(F.col("match_count") == 1, F.col("_v"))).drop("_v")


def keep_newest(rows: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    """One row a key: the newest (nulls last), then the smallest tie."""
    w = W.partitionBy(*keys).orderBy(F.desc_nulls_last(newest), tie)
    return rows.withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def top_documents(rows: DataFrame, order: list[Column], most: int, name: str) -> DataFrame:
    """One row: a JSON array of the first ``most`` rows in order (a report; the limit is its point)."""
    w = W.orderBy(*order)
    top = rows.orderBy(*order).limit(most).withColumn("_i", F.row_number().over(w))
    got = top.agg(F.array_sort(F.collect_list(F.struct("_i", F.struct(*rows.columns).alias("row")))).alias("a"))
    return got.select(F.to_json(F.transform("a", lambda x: x["row"])).alias(name))


def counts_of(frames: dict[str, DataFrame]) -> DataFrame:
    """name, n of each frame."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def review_groups(resolutions: DataFrame, keys: list[str], separator: str = chr(31)) -> DataFrame:
    """Groups of alike unresolved rows with a stable key: keys, n, first and last time, review_key."""
    x = resolutions.where("status <> 'resolved'").groupBy(*keys).agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.min(F.when(F.col("name").isNotNull(), F.col("name"))).alias("example"))
    return x.withColumn("review_key", F.sha2(F.concat_ws(separator, *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys)), 256))


def bridge_rows(patterns: DataFrame, sent: DataFrame, least: float = 0.7) -> DataFrame:
    """Patterns to hand on: sure enough, not sent before, one a dedup key, with severity. patterns:
    pattern_id, dedup_key, confidence."""
    from ..functions.columns import severity_by_confidence

    x = patterns.where(F.col("confidence") >= least).join(sent.select("dedup_key").distinct(), "dedup_key", "left_anti")
    x = keep_newest(x, ["dedup_key"], "confidence", "pattern_id")
    return x.withColumn("severity", severity_by_confidence(F.col("confidence")))


def drained(rows: DataFrame, bridged: DataFrame, required: list[str]) -> DataFrame:
    """rows not bridged yet, with ``reject``: the first required field that is missing, or null."""
    why = F.lit(None).cast("string")
    for f in reversed(required):
        why = F.when(F.col(f).isNull(), F.lit(f"missing_{f}")).otherwise(why)
    return rows.join(bridged.select("id").distinct(), "id", "left_anti").withColumn("reject", why)


def status_counts(rows: DataFrame, state: str, states: list[str]) -> DataFrame:
    """One row: how many rows are in each state."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(state) == s).alias(s) for s in states))


def count_map(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """keys, a text of value:count sorted by value."""
    c = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(value).cast("string").alias("v"), "n")))
    return c.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["v"], p["n"].cast("string"))), ",").alias(out))


def bind_traits(traits: DataFrame, versions: DataFrame) -> DataFrame:
    """Traits bound to versions of their document: by run exactly, else by a content hash that only one
    version has, else unresolved. traits: trait_id, document_id, run_id, hashes; versions: version_key,
    document_id, run_id, hashes."""
    runs = versions.groupBy("document_id", "run_id").agg(F.count("*").alias("n"), F.min("version_key").alias("exact")).where("n = 1").drop("n")
    x = traits.join(runs, ["document_id", "run_id"], "left")
    rest = x.where("exact is null").select("trait_id", "document_id", F.explode("hashes").alias("h"))
    by_hash = versions.select("document_id", "version_key", F.explode("hashes").alias("h"))
    found = rest.join(by_hash, ["document_id", "h"]).groupBy("trait_id").agg(F.count_distinct("version_key").alias("n"), F.min("version_key").alias("historical")).where("n = 1").drop("n")
    x = x.join(found, "trait_id", "left")
    state = F.when(F.col("exact").isNotNull(), "exact").when(F.col("historical").isNotNull(), "historical").otherwise("unresolved")
    return x.select("trait_id", "document_id", F.coalesce("exact", "historical").alias("version_key"), state.alias("binding"))


def find_stream(requests: DataFrame, streams: DataFrame) -> DataFrame:
    """request_id -> stream_id: by explicit id, by source as id, then by what is unique among streams:
    (jurisdiction, module), jurisdiction, module; else the only stream; else null. requests: request_id,
    want, source_id, jurisdiction_id, module; streams: stream_id, jurisdiction_id, module."""
    ids = streams.select("stream_id")
    x = requests.join(ids.select(F.col("stream_id").alias("want"), F.col("stream_id").alias("_a")), "want", "left").join(ids.select(F.col("stream_id").alias("source_id"), F.col("stream_id").alias("_b")), "source_id", "left")
    for i, keys in enumerate((["jurisdiction_id", "module"], ["jurisdiction_id"], ["module"])):
        one = streams.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("stream_id").alias(f"_c{i}")).where("_n = 1").drop("_n")
        x = x.join(one, keys, "left")
    only = streams.agg(F.when(F.count("*") == 1, F.min("stream_id")).alias("_d"))
    return x.crossJoin(F.broadcast(only)).select("request_id", F.coalesce("_a", "_b", "_c0", "_c1", "_c2", "_d").alias("stream_id"))
