"""The rules by which events name entities, as a manifest whose digest binds runs to them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from .canonical import digest

EXACT, IGNORED = "first_non_empty_exact_field", "explicit_ignored_outcome"


@dataclass(frozen=True)
class Rule:
    rule_id: str
    stream_id: str
    signal_types: tuple[str, ...]
    entity_role: str
    expected_type: str | None
    names: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()
    id_kinds: tuple[str, ...] = ()
    transform: str = EXACT
    version: str = "1.0.0"


# The rules' ids, streams, roles, types and fields.
RULES = (
    Rule("pro_publica.nonprofit_registry_record.subject_nonprofit", "pro_publica", ("nonprofit_registry_record",), "subject_nonprofit", "nonprofit", ("payload.name", "payload.raw.name", "payload.raw.sub_name"), ("payload.ein", "payload.external_id", "payload.raw.ein"), ("ein",)),
    Rule("pro_publica.nonprofit_990.subject_nonprofit", "pro_publica", ("nonprofit_990", "nonprofit_990_filing"), "subject_nonprofit", "nonprofit", ("payload.organization_name", "payload.name", "payload.raw.organization_name", "payload.raw.name"), ("payload.ein", "payload.raw.ein"), ("ein",)),
    Rule("cfpb_complaints.complained_against_entity", "cfpb_complaints", ("*",), "complained_against_entity", "organization", ("payload.company", "payload.employer")),
    Rule("eeoc_filings.respondent_employer", "eeoc_filings", ("*",), "respondent_employer", "organization", ("payload.employer",)),
    Rule("sec_edgar.issuer", "sec_edgar", ("*",), "issuer", "organization", ("payload.company",), ("payload.cik",), ("cik",)),
    Rule("regulations_gov.issuing_agency", "regulations_gov", ("*",), "issuing_agency", "government_agency", ("payload.agency", "payload.agency_name")),
    Rule("usa_spending.award_recipient", "usa_spending", ("*",), "award_recipient", "organization", ("payload.recipient_name", "payload.recipient", "payload.award_recipient", "payload.recipient_legal_entity_name", "payload.title"), ("payload.recipient_uei", "payload.uei", "payload.recipient_duns", "payload.duns"), ("uei", "duns"), "first_exact_field_or_contract_title_recipient_prefix"),
    Rule("usa_spending.awarding_agency", "usa_spending", ("*",), "awarding_agency", "government_agency", ("payload.agency", "payload.awarding_agency_name")),
    Rule("grants_gov.granting_agency", "grants_gov", ("*",), "granting_agency", "government_agency", ("payload.agency", "payload.agency_name")),
    Rule("open_states.legislative_sponsor", "open_states", ("*",), "legislative_sponsor", "person", ("payload.sponsor", "payload.sponsor_name", "payload.sponsors[*]"), transform="direct_or_array_exact_sponsor_name"),
    Rule("generic.canonical_entity_id", "*", ("*",), "subject_entity", None, ("payload.entity_name", "payload.entity"), ("payload.canonical_entity_id",), ("canonical_entity_id",), "exact_canonical_entity_id"),
    Rule("generic.declared_subject_field", "*", ("*",), "subject_entity", None, ("payload.entity_name", "payload.entity")),
    Rule("system.no_declared_entity_rule", "*", ("*",), "none", None, transform=IGNORED),
)


def manifest(rules: tuple[Rule, ...] = RULES) -> dict:
    """rules as an object with its digest. Raises where ids repeat, a rule with identifiers names no kind, or
    no rule says what happens to events that no rule is about."""
    ids = [r.rule_id for r in rules]
    if len(set(ids)) != len(ids):
        raise ValueError("rules need ids of their own")
    for r in rules:
        if bool(r.ids) != bool(r.id_kinds):
            raise ValueError(f"{r.rule_id}: identifier fields and kinds belong together")
        if not r.names and r.transform != IGNORED:
            raise ValueError(f"{r.rule_id} reads no field")
    if sum(r.transform == IGNORED for r in rules) != 1:
        raise ValueError("exactly one rule is about events without an entity")
    rows = [{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(r).items()} for r in rules]
    return {"rules": rows, "count": len(rows), "digest": digest(rows)}


def applicable(stream_id: str, signal_type: str, rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules for events of a stream and type: its own, else the general ones."""
    fits = [r for r in rules if r.stream_id == stream_id and ("*" in r.signal_types or signal_type in r.signal_types)]
    return fits or [r for r in rules if r.stream_id == "*" and r.transform != IGNORED] or [r for r in rules if r.transform == IGNORED]


def extraction(rules: tuple[Rule, ...] = RULES) -> dict[str, list[dict]]:
    """The rules of named streams in the form that entity candidates are extracted by. An identifier field
    belongs to the kind that its name ends in, or to the rule's only kind."""
    out: dict[str, list[dict]] = {}
    for r in rules:
        if r.stream_id == "*":
            continue
        ids = {kind: tuple(p for p in r.ids if len(r.id_kinds) == 1 or p.endswith(kind)) for kind in r.id_kinds}
        lists = [n.removesuffix("[*]") for n in r.names if n.endswith("[*]")]
        own = {"role": r.entity_role, "type": r.expected_type, "names": tuple(n for n in r.names if not n.endswith("[*]")), "ids": ids}
        out.setdefault(r.stream_id, []).append(own | ({"many": lists[0]} if lists else {}))
    return out
