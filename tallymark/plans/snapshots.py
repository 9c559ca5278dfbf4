"""Snapshots from another deployment: checked by their own digests, taken in once, projected if they hold one bill.

A snapshot says of what it is (contract, owner, scope, time, method), holds components each with a digest,
and has a digest over all and a receipt of its export. Nothing of a snapshot is used before every digest has
been computed again and found equal.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .canonical import digest

_HEX = re.compile("[0-9a-f]{64}")
COMPONENT = ("component_id", "component_type", "canonical_record_id", "inclusion_state", "jurisdiction_code", "temporal_scope", "value", "source_bindings", "source_verification", "unresolved_conditions")
HEAD = ("contract_id", "contract_version", "canonical_owner", "snapshot_id", "snapshot_kind", "immutable", "as_of", "methodology_version", "component_count", "completeness_state")


class SnapshotError(ValueError):
    pass


def component_basis(c: dict) -> dict:
    """What a component's digest covers, lists in a fixed order."""
    basis = {k: c.get(k) for k in COMPONENT}
    for k in ("source_bindings", "source_verification"):
        basis[k] = sorted(basis[k] or [], key=lambda x: json.dumps(x, sort_keys=True))
    basis["unresolved_conditions"] = sorted(set(basis["unresolved_conditions"] or []))
    return basis


def snapshot_basis(s: dict) -> dict:
    scope = s.get("scope") or {}
    basis = {k: s.get(k) for k in HEAD}
    basis["scope"] = {"scope_type": scope.get("scope_type"), **{k: sorted(set(scope.get(k) or [])) for k in ("scope_ids", "jurisdiction_codes")}}
    basis["components"] = sorted(({**component_basis(c), "component_hash": c["component_hash"]} for c in s["components"]), key=lambda c: c["component_id"])
    for k in ("unresolved_conditions", "excluded_component_types"):
        basis[k] = sorted(set(s.get(k) or []))
    return basis


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise SnapshotError(why)


def _hex(x) -> bool:
    return isinstance(x, str) and bool(_HEX.fullmatch(x))


def _time(x) -> bool:
    try:
        datetime.fromisoformat(str(x).replace("Z", "+00:00"))
    except ValueError:
        return False
    return True


def check(s: dict, contract: tuple[str, str], owner: str, types: frozenset[str], namespace: str) -> str:
    """The digest of a valid snapshot; raises SnapshotError with the first thing that is wrong."""
    _need(isinstance(s, dict), "not_an_object")
    _need((s.get("contract_id"), s.get("contract_version")) == contract, "contract_mismatch")
    _need(s.get("canonical_owner") == owner and s.get("snapshot_kind") == "baseline_export" and s.get("immutable") is True, "source_boundary_mismatch")
    _need(_time(s.get("as_of")), "as_of_invalid")
    parts = s.get("components")
    _need(isinstance(parts, list) and all(isinstance(c, dict) for c in parts), "components_required")
    _need(s.get("component_count") == len(parts) and not isinstance(s["component_count"], bool), "component_count_mismatch")
    for c in parts:
        _need(str(c.get("component_id", "")).startswith(namespace), "component_namespace_mismatch")
        _need(c.get("component_type") in types, "component_type_not_governed")
        _need(bool(c.get("source_bindings")) and bool(c.get("source_verification")), "source_trace_required")
        _need(_hex(c.get("component_hash")) and c["component_hash"] == digest(component_basis(c)), "component_hash_mismatch")
    _need(len({c["component_id"] for c in parts}) == len(parts), "duplicate_component_id")
    own = digest(snapshot_basis(s))
    _need(s.get("snapshot_hash") == own, "snapshot_hash_mismatch")
    receipt = s.get("export_receipt")
    _need(isinstance(receipt, dict) and receipt.get("snapshot_hash") == own, "receipt_snapshot_hash_mismatch")
    key = replay_key(s, own)
    _need(receipt.get("deterministic_replay_key") == key, "replay_key_mismatch")
    basis = {"export_receipt_id": receipt.get("export_receipt_id"), "snapshot_hash": own, "deterministic_replay_key": key, "source_commit_sha": receipt.get("source_commit_sha")}
    _need(receipt.get("export_receipt_hash") == digest(basis), "export_receipt_hash_mismatch")
    _need(_time(receipt.get("generated_at")), "generated_at_invalid")
    return own


def replay_key(s: dict, own: str) -> str:
    return digest({"contract_id": s["contract_id"], "contract_version": s["contract_version"], "snapshot_id": s["snapshot_id"], "snapshot_hash": own, "methodology_version": s.get("methodology_version")})


CHECKED = "body string, snapshot_id string, snapshot_hash string, reason string"


def checked(snapshots: DataFrame, contract: tuple[str, str], owner: str, types: frozenset[str], namespace: str, body: str = "body") -> DataFrame:
    """CHECKED of each snapshot (JSON text); reason is null where all digests hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                key = own = why = None
                try:
                    s = json.loads(text) if text is not None else None
                    key = s.get("snapshot_id") if isinstance(s, dict) else None
                    own = check(s, contract, owner, types, namespace)
                except SnapshotError as e:
                    why = str(e)
                except (ValueError, TypeError, KeyError, AttributeError):
                    why = "malformed"
                out.append((text, key if isinstance(key, str) else None, own, why))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)] if out else [pa.array([], pa.string())] * 4, ["body", "snapshot_id", "snapshot_hash", "reason"])

    return snapshots.select(F.col(body).cast("string")).mapInArrow(run, CHECKED)


def taken_in(found: DataFrame, stored: DataFrame) -> DataFrame:
    """The valid snapshots of ``checked`` that are not stored, once each. A snapshot whose id is stored with
    another digest is a conflict and raises: snapshots do not change."""
    good = found.where("reason is null").dropDuplicates(["snapshot_hash"])
    known = stored.select("snapshot_id", F.col("snapshot_hash").alias("_known"))
    clash = good.join(known, "snapshot_id").where("_known <> snapshot_hash").select("snapshot_id").first()
    if clash:
        raise SnapshotError(f"{clash.snapshot_id} is stored with another digest")
    return good.join(stored.select("snapshot_hash"), "snapshot_hash", "left_anti").select("body", "snapshot_id", "snapshot_hash")


def version_order(v: dict) -> tuple:
    return (v.get("stage_order") or 0, v.get("version_sequence") or 0, str(v.get("bill_version_id")))


def legislative_rows(s: dict, run_field: str = "extraction_run_id") -> list[dict]:
    """A row for each version of the one bill in a checked snapshot, with how many traits its extraction run
    made: family, jurisdiction, version, place, processing state, run, traits. run_field: where a version names its run."""
    bills = [c for c in s["components"] if c["component_type"] == "bill"]
    _need(len(bills) == 1, "exactly_one_bill_required")
    value = bills[0]["value"] or {}
    versions = sorted(value.get("bill_versions") or [], key=version_order)
    head = value.get("bill_version_manifest") or {}
    _need(head.get("version_count") == len(versions) and head.get("manifest_hash") == digest(versions), "version_manifest_mismatch")
    codes = s["scope"].get("jurisdiction_codes") or []
    _need(len(codes) == 1 and bool(s["scope"].get("scope_ids")), "single_jurisdiction_required")
    made: dict[str, int] = {}
    for c in s["components"]:
        run = (c.get("value") or {}).get("extraction_run_id") if c["component_type"] == "trait" else None
        if run:
            made[run] = made.get(run, 0) + 1
    out = []
    for i, v in enumerate(versions, 1):
        _need(bool(v.get("bill_version_id")) and bool(v.get("processing_state")), "version_incomplete")
        run = v.get(run_field)
        out.append({"family_id": s["scope"]["scope_ids"][0], "jurisdiction_id": codes[0], "version_id": v["bill_version_id"], "place": i, "processing_state": v["processing_state"], "run_id": run, "traits": made.get(run, 0) if run else 0})
    return out
