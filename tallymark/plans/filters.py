"""Governed filters: a stack of named filters is validated, merged and turned into one predicate.

A filter belongs to a category and a permission level. Hardened filters cannot be switched off by a
request; a filter asked for twice must have equal parameters. The effective stack has a total order and a
digest, and ``apply`` puts its predicate on a DataFrame, where Catalyst pushes it into the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .canonical import digest

CATEGORIES = ("source", "signal_type", "domain_space", "jurisdiction", "time_window", "actor_entity", "relationship", "provenance", "convergence", "deduplication_exclusion", "integrity")
RANK = {"user_swappable": 1, "governed": 2, "hardened": 3}


@dataclass(frozen=True)
class Kind:
    name: str
    category: str
    permission: str
    parameters: tuple[str, ...] = ()


#: fixed values: filters, their categories, permissions and parameters
KINDS = {
    k.name: k
    for k in (
        Kind("source_scope", "source", "user_swappable", ("source_ids", "source_families")),
        Kind("signal_type_scope", "signal_type", "user_swappable", ("signal_types",)),
        Kind("domain_space_scope", "domain_space", "user_swappable", ("space_types", "space_ids")),
        Kind("jurisdiction_scope", "jurisdiction", "user_swappable", ("jurisdiction_ids",)),
        Kind("time_window_scope", "time_window", "user_swappable", ("start", "end", "as_of")),
        Kind("actor_entity_scope", "actor_entity", "user_swappable", ("entity_ids",)),
        Kind("relationship_scope", "relationship", "user_swappable", ("relationship_types",)),
        Kind("provenance_threshold", "provenance", "governed", ("minimum_confidence",)),
        Kind("convergence_window", "convergence", "governed", ("minimum_signal_count", "window_ms")),
        Kind("deterministic_deduplication", "deduplication_exclusion", "governed", ("fingerprint_rule_id",)),
        Kind("canonical_source_identity_required", "integrity", "hardened"),
        Kind("unresolved_state_preservation", "integrity", "hardened"),
        Kind("contradiction_state_preservation", "integrity", "hardened"),
        Kind("provenance_trace_preservation", "integrity", "hardened"),
    )
}
HARDENED = tuple(k for k, v in KINDS.items() if v.permission == "hardened")


class FilterError(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    kind: Kind
    parameters: dict = field(default_factory=dict)
    enabled: bool = True

    @classmethod
    def of(cls, asked) -> Filter:
        asked = {"filter_id": asked} if isinstance(asked, str) else asked
        kind = KINDS.get(str(asked.get("filter_id", "")).strip())
        if kind is None:
            raise FilterError(f"unknown filter {asked.get('filter_id')!r}")
        given = {}
        for k, v in (asked.get("parameters") or {}).items():
            if k not in kind.parameters:
                raise FilterError(f"{kind.name} has no parameter {k}")
            if isinstance(v, (list, tuple)):
                if not all(isinstance(x, str) and x.strip() for x in v):
                    raise FilterError(f"{kind.name}.{k} must hold texts")
                v = sorted({x.strip() for x in v})
            given[k] = v
        _ranges(kind.name, given)
        return cls(kind, given, asked.get("enabled", True) is not False)


def _ranges(name: str, p: dict) -> None:
    c = p.get("minimum_confidence")
    if c is not None and not 0 <= c <= 1:
        raise FilterError("minimum_confidence is outside [0, 1]")
    n = p.get("minimum_signal_count")
    if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 2):
        raise FilterError("minimum_signal_count is below 2")
    w = p.get("window_ms")
    if w is not None and (isinstance(w, bool) or not isinstance(w, int) or w <= 0):
        raise FilterError("window_ms is not positive")
    if name == "time_window_scope":
        for k in ("start", "end", "as_of"):
            if p.get(k) is not None and (isinstance(p[k], bool) or not isinstance(p[k], int)):
                raise FilterError(f"{k} is no time in milliseconds")


@dataclass(frozen=True)
class Stack:
    effective: tuple[Filter, ...]
    blocked: tuple[str, ...]

    @property
    def receipt(self) -> str:
        return digest([{"id": f.kind.name, "parameters": f.parameters} for f in self.effective])

    def apply(self, rows: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
        """rows that pass. columns: names that differ from the defaults below."""
        at = {"source_ids": "source_id", "source_families": "source_family", "signal_types": "signal_type", "space_types": "space_type", "space_ids": "space_id", "jurisdiction_ids": "jurisdiction_id",
              "entity_ids": "entity_id", "relationship_types": "relationship_type", "time": "ts_ms", "confidence": "confidence", "identity": "identity_hash", "group": "geography", "fingerprint": "fingerprint", "id": "offset"} | (columns or {})
        parts, windows = [], []
        for f in self.effective:
            p = f.parameters
            for k, v in p.items():
                if isinstance(v, list):
                    parts.append(F.arrays_overlap(F.col(at[k]), F.array(*map(F.lit, v))) if dict(rows.dtypes)[at[k]].startswith("array") else F.col(at[k]).isin(v))
            if f.kind.name == "time_window_scope":
                parts += [F.col(at["time"]) >= p["start"]] if p.get("start") is not None else []
                parts += [F.col(at["time"]) <= p[k] for k in ("end", "as_of") if p.get(k) is not None]
            elif f.kind.name == "provenance_threshold" and p.get("minimum_confidence") is not None:
                parts.append(F.col(at["confidence"]) >= p["minimum_confidence"])
            elif f.kind.name == "canonical_source_identity_required":
                parts.append(F.col(at["identity"]).isNotNull())
            elif f.kind.name in ("convergence_window", "deterministic_deduplication"):
                windows.append(f)
        out = rows.where(reduce(lambda a, b: a & b, parts)) if parts else rows
        for f in sorted(windows, key=lambda f: f.kind.name == "convergence_window"):
            if f.kind.name == "deterministic_deduplication":
                best = out.groupBy(at["fingerprint"]).agg(F.min(F.struct((-F.coalesce(at["confidence"], F.lit(-1.0))).alias("c"), F.col(at["id"]).alias("i")))["i"].alias(at["id"]))
                out = out.join(best, [at["fingerprint"], at["id"]], "left_semi")
            elif f.parameters.get("minimum_signal_count"):
                keys = [F.col(at["group"])]
                if f.parameters.get("window_ms"):
                    keys.append(F.floor(F.col(at["time"]) / f.parameters["window_ms"]))
                w = W.partitionBy(*keys)
                out = out.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= f.parameters["minimum_signal_count"]).drop("__n")
        return out


def resolve(requested=(), module_required=(), domain_required=(), system=HARDENED) -> Stack:
    chosen: dict[str, Filter] = {}
    blocked = []
    for group, asked in (("system", system), ("module", module_required), ("domain", domain_required), ("requested", requested)):
        for f in map(Filter.of, asked):
            hard = f.kind.permission == "hardened"
            if group == "system" and not hard:
                raise FilterError(f"{f.kind.name} is not hardened")
            if not f.enabled:
                if group != "requested":
                    raise FilterError(f"{f.kind.name} is required and cannot be disabled")
                if hard:
                    blocked.append(f.kind.name)
                continue
            known = chosen.setdefault(f.kind.name, f)
            if known.parameters != f.parameters:
                raise FilterError(f"{f.kind.name} is asked for with different parameters")
    order = lambda f: (CATEGORIES.index(f.kind.category), -RANK[f.kind.permission], f.kind.name)
    return Stack(tuple(sorted(chosen.values(), key=order)), tuple(blocked))
