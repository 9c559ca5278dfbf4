"""Graphs of geographies and relationships between entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import time_bucket
from ..storage import cut


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).where("src <> dst").distinct()


def hops(edges: DataFrame, source: str, nodes: DataFrame, directed: bool = False, most: int | None = None) -> DataFrame:
    """node, hops from source; null where unreachable. Breadth first: each round joins the frontier to
    the edges and leaves out what was seen, until no node is new (or to ``most`` hops where that is asked
    for). No node is visited twice; there are as many rounds as the graph is deep."""
    both = edges.select("src", "dst").distinct() if directed else undirected(edges)
    seen = nodes.where(F.col("node") == source).select("node", F.lit(0).alias("hops"))
    frontier, level = seen, 0
    limit = most if most is not None else nodes.count() + 1
    while level < limit:
        level += 1
        step = frontier.select(F.col("node").alias("src")).join(both, "src").select(F.col("dst").alias("node")).distinct()
        step = cut(step.join(seen, "node", "left_anti").select("node", F.lit(level).alias("hops")))
        if step.isEmpty():
            break
        seen, frontier = seen.union(step), step
    return nodes.select("node").join(seen, "node", "left")


def registry_faults(registry: DataFrame, edges: DataFrame) -> DataFrame:
    """fault, subject of each defect. registry: node, name, lat, lon, area; edges: src, dst."""
    fault = lambda df, kind, subject: df.select(F.lit(kind).alias("fault"), F.col(subject).cast("string").alias("subject"))
    twice = registry.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    bad = registry.where("node is null or name is null or trim(name) = ''")
    where = registry.where("lat not between -90 and 90 or lon not between -180 and 180")
    area = registry.where("area is null or area <= 0")
    unknown = edges.join(registry.select(F.col("node").alias("dst")), "dst", "left_anti")
    one_way = edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").withColumn("edge", F.concat_ws(">", "src", "dst"))
    loop = edges.where("src = dst")
    out = fault(twice, "duplicate", "node")
    for df, kind, col in ((bad, "missing_field", "node"), (where, "coordinate_range", "node"), (area, "area_range", "node"), (unknown, "unknown_neighbour", "dst"), (one_way, "one_way", "edge"), (loop, "self", "src")):
        out = out.union(fault(df, kind, col))
    return out


def relationships(members: DataFrame, co: float = 1.0, temporal: float = 0.0, stream: float = 0.0, bucket_ms: int | None = None) -> DataFrame:
    """Entity pairs by shared signals. members: signal_id, entity_id, stream_id, ts_ms. Pairs come from
    the signals themselves, never from all entities."""
    m = members.select("signal_id", "entity_id", "stream_id", "ts_ms").dropDuplicates(["signal_id", "entity_id"])
    degree = m.groupBy("entity_id").agg(F.count("*").alias("n"))
    bucket = time_bucket(F.col("ts_ms"), bucket_ms) if bucket_ms else F.lit(None).cast("long")
    pairs = m.alias("a").join(m.alias("b"), F.expr("a.signal_id = b.signal_id and a.entity_id < b.entity_id")).select(F.col("a.entity_id").alias("a"), F.col("b.entity_id").alias("b"), F.col("a.stream_id").alias("stream_id"), bucket.alias("bucket") if bucket_ms is None else time_bucket(F.col("a.ts_ms"), bucket_ms).alias("bucket"))
    x = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_distinct("bucket").alias("buckets"), F.count_distinct("stream_id").alias("streams"))
    x = x.join(degree.select(F.col("entity_id").alias("a"), F.col("n").alias("n_a")), "a").join(degree.select(F.col("entity_id").alias("b"), F.col("n").alias("n_b")), "b")
    jaccard = F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    when = F.when(F.col("buckets") > 0, 1.0 / F.col("buckets")).otherwise(F.lit(0.0))
    strength = co * jaccard + temporal * when + stream * F.col("streams") / F.col("shared")
    return x.select("a", "b", "shared", F.round(jaccard, 9).alias("jaccard"), "buckets", "streams", F.round(strength, 9).alias("strength"))


def version_edges(versions: DataFrame) -> DataFrame:
    """Predecessor and base of each version of a document, in order of stage, sequence and key.
    versions: document_id, version_key, stage, sequence."""
    w = W.partitionBy("document_id").orderBy("stage", "sequence", "version_key")
    x = versions.withColumn("predecessor", F.lag("version_key").over(w)).withColumn("base", F.first("version_key").over(w)).withColumn("place", F.row_number().over(w))
    return x.select("document_id", "version_key", "place", "predecessor", F.when(F.col("place") > 1, F.col("base")).alias("base"))
