"""Module definitions: what a module asks, of which sources, and whether its bindings are operational."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import filters, lenses
from .canonical import digest
from .domains import DomainSpace


@dataclass(frozen=True)
class Module:
    module_id: str
    version: str
    question: str
    space: DomainSpace
    bindings: tuple[dict, ...]  #: connector_id, schema_id, adapter_class, required
    signal_types: tuple[str, ...]
    lens_weights: dict
    required_filters: tuple = ()

    def __post_init__(self):
        if not self.module_id.strip() or not self.question.strip() or not self.signal_types or not self.bindings:
            raise ValueError("a module needs an id, a question, signal types and bindings")
        if not re.fullmatch(r"\d+\.\d+\.\d+", self.version):
            raise ValueError("a version has three numbers")

    def compiled(self) -> dict:
        body = {
            "module_id": self.module_id, "version": self.version, "question": self.question, "space": self.space.identity, "bindings": sorted(self.bindings, key=lambda b: b["connector_id"]),
            "signal_types": sorted(set(self.signal_types)), "filters": filters.resolve(module_required=self.required_filters).receipt, "lenses": lenses.stack(self.lens_weights)}
        return body | {"definition_hash": digest(body)}


def operational(bindings: DataFrame, connectors: DataFrame, schemas: DataFrame) -> DataFrame:
    """Each binding with its state and reasons. bindings: module_id, connector_id, schema_id,
    adapter_class, required; connectors: connector_id, adapter_class, schema_id, active; schemas:
    schema_id, active."""
    c = connectors.select("connector_id", F.col("adapter_class").alias("_class"), F.col("schema_id").alias("_schema"), F.col("active").alias("_active"), F.lit(True).alias("_c"))
    s = schemas.select("schema_id", F.col("active").alias("_s_active"), F.lit(True).alias("_s"))
    x = bindings.join(c, "connector_id", "left").join(s, "schema_id", "left")
    has = F.col("_c").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(has & ~F.col("adapter_class").eqNullSafe(F.col("_class")), "adapter_class_mismatch"), F.when(has & ~F.coalesce("_active", F.lit(False)), "connector_inactive"),
        F.when(~has, "connector_not_found"), F.when(has & ~F.col("schema_id").eqNullSafe(F.col("_schema")), "connector_schema_mismatch"),
        F.when(F.col("_s").isNotNull() & ~F.coalesce("_s_active", F.lit(False)), "schema_inactive"), F.when(F.col("_s").isNull(), "schema_not_found")))
    state = F.when(F.size("reasons") == 0, "ready").when(F.col("required"), "blocked").otherwise("degraded")
    return x.withColumn("reasons", reasons).withColumn("state", state).select(*bindings.columns, "state", F.array_join("reasons", ",").alias("reasons"))


def module_state(states: DataFrame) -> DataFrame:
    return states.groupBy("module_id").agg(F.when(F.bool_or(F.col("state") == "blocked"), "blocked").when(F.bool_or(F.col("state") == "degraded"), "degraded").otherwise("ready").alias("state"))
