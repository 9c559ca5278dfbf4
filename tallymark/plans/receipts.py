"""Manifests, receipts and replay: a result is bound to its inputs, rules and engine version by digests,
and a replay must give the same ones."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from .canonical import canonical, digest

ENGINE_VERSION = "1.0.0"
_SHA = re.compile("[0-9a-f]{64}")


@dataclass(frozen=True)
class Manifest:
    computation: str
    as_of_ms: int
    rules: str  #: digests
    population: str
    signal_count: int
    configuration: dict = field(default_factory=dict)
    registry: str | None = None
    filters: str | None = None
    lenses: str | None = None
    space: str | None = None
    engine: str = ENGINE_VERSION

    def __post_init__(self):
        if not self.computation or not isinstance(self.as_of_ms, int):
            raise ValueError("a manifest needs a computation and an explicit time")
        if not isinstance(self.signal_count, int) or self.signal_count < 0:
            raise ValueError("a manifest needs a count of signals")
        for name in ("rules", "population", "registry", "filters", "lenses", "space"):
            v = getattr(self, name)
            if v is None and name not in ("rules", "population"):
                continue
            if not isinstance(v, str) or not _SHA.fullmatch(v):
                raise ValueError(f"{name} must be a SHA-256 digest")

    @property
    def digest(self) -> str:
        return digest({k: v for k, v in asdict(self).items() if v is not None})


@dataclass(frozen=True)
class Receipt:
    manifest: str
    output: str
    previous: str | None = None

    @property
    def identity(self) -> str:
        return digest({"manifest": self.manifest, "output": self.output, "previous": self.previous})

    def verify(self, manifest: Manifest, output) -> bool:
        return self.manifest == manifest.digest and self.output == digest(output)


def issue(manifest: Manifest, output, previous: Receipt | None = None) -> Receipt:
    return Receipt(manifest.digest, digest(output), previous.identity if previous else None)


def chained(receipts: list[Receipt]) -> bool:
    return all(b.previous == a.identity for a, b in zip(receipts, receipts[1:]))


def run_key(manifest: Manifest) -> str:
    return manifest.digest


@dataclass(frozen=True)
class Replay:
    same_manifest: bool
    same_output: bool

    @property
    def ok(self) -> bool:
        return self.same_manifest and self.same_output


def replay(receipt: Receipt, manifest: Manifest, compute: Callable[[], object]) -> Replay:
    """Recomputes and compares; never trusts a stored output."""
    return Replay(receipt.manifest == manifest.digest, receipt.output == digest(compute()))


def stored_equal(a, b) -> bool:
    return canonical(a) == canonical(b)


class AcceptanceError(RuntimeError):
    pass


def accept(manifest: Manifest, compute: Callable[[], object], persist: Callable[[Receipt, object], str]) -> dict:
    """Runs, persists and replays; a summary if both the writing and the replay succeed, else an error. persist:
    gives written or unchanged."""
    output = compute()
    receipt = issue(manifest, output)
    status = persist(receipt, output)
    if status not in ("written", "unchanged"):
        raise AcceptanceError(f"nothing was persisted: {status}")
    again = replay(receipt, manifest, compute)
    if not again.ok:
        raise AcceptanceError("the replay differs in its " + ("output" if again.same_manifest else "manifest"))
    return {"run_key": run_key(manifest), "receipt": receipt.identity, "output": receipt.output, "persistence": status, "replay_consistent": True}
