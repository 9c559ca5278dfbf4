"""Forms, deadlines and agencies in free text, as column expressions.

A text is scanned for what speaks of a form; context windows around the matches that touch are merged into
blocks; each block gives a form record with candidates, a confidence, a review status and flags; records of one
text that agree in their composite key become one; staging tables list what reviewers need. Everything up to
the records stays within a row, so nothing is shuffled before records are deduplicated.

A pattern is only run where a plain word that it needs occurs; places come from the lengths of what lies
between matches. The vocabularies are parameters with defaults.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import let, squeezed, web_address
from ..tables import joined_hash

# The vocabulary that texts are searched for.
ACTIONS = ("apply", "file", "submit", "complaint", "appeal", "request", "hearing", "petition", "intake", "report", "grievance", "claim", "dispute", "challenge", "objection", "reconsideration", "determination")
INDICATORS = ("form", "request", "application", "complaint", "appeal", "notice", "filing", "petition", "claim form", "complaint form", "hearing request")
DOMAINS = {
    "housing": ("eviction", "rent", "lease", "foreclosure", "housing", "landlord", "tenant", "property", "mortgage", "homeowner", "habitability", "uninhabitable", "housing violation", "rent strike", "code enforcement"),
    "wage": ("wage", "salary", "overtime", "labor", "wage theft", "unpaid", "paycheck", "employment", "employee", "hour", "compensation", "retaliation", "wage and hour", "labor commissioner", "workplace"),
    "benefits": ("unemployment", "workers comp", "workers compensation", "disability", "benefit", "social security", "medicare", "medicaid", "denied", "appeal", "public assistance", "snap", "food stamps"),
    "insurance": ("insurance", "claim", "claim denied", "coverage denied", "coverage", "premium", "policy", "deductible", "appeal", "insurer"),
    "healthcare": ("medical", "healthcare", "health care", "hospital", "doctor", "provider", "treatment", "diagnosis", "prescription", "denied treatment"),
    "legal": ("attorney", "lawyer", "court", "lawsuit", "litigation", "complaint", "appeal", "motion", "petition", "hearing"),
}
WORKFLOWS = {
    "insurance_denial": (("insurance", "claim denied"), ("coverage denied",), ("appeal", "insurance"), ("insurer", "appeal")),
    "housing_violation": (("eviction",), ("housing violation",), ("uninhabitable",), ("rent strike",), ("housing complaint",), ("housing code",), ("code enforcement", "housing")),
    "wage_theft": (("wage theft",), ("unpaid wages",), ("wage dispute",), ("labor complaint",), ("wage and hour",), ("labor commissioner",), ("overtime", "unpaid")),
    "benefits_denial": (("unemployment denied",), ("workers compensation",), ("workers comp",), ("benefits appeal",), ("benefit denial",), ("ui appeal",), ("disability appeal",)),
}
STAGES = {
    "intake": ("apply", "application", "intake", "submit", "file", "initial complaint", "report"),
    "appeal": ("appeal", "reconsideration", "review request", "challenge determination"),
    "hearing": ("hearing", "administrative hearing", "appeals hearing", "tribunal"),
    "escalation": ("grievance", "ombudsman", "supervisor review", "civil rights complaint", "court filing"),
}
# Per jurisdiction its patterns, each of which counts once; with a lower-case word that a match holds.
JURISDICTIONS = {
    "CA": ((r"(?i)\bcalifornia\b", "california"), (r"\bCA\b", "ca"), (r"(?i)\bCal.\b", "cal")),
    "NY": ((r"(?i)\bnew york\b", "new york"), (r"\bNY\b", "ny")),
    "TX": ((r"(?i)\btexas\b", "texas"), (r"\bTX\b", "tx")),
    "FL": ((r"(?i)\bflorida\b", "florida"), (r"\bFL\b", "fl")),
    "WA": ((r"(?i)\bwashington\b", "washington"), (r"\bWA\b", "wa")),
    "Federal": ((r"(?i)\bfederal\b", "federal"), (r"(?i)\bunited states\b", "united states"), (r"(?i)\bU.S.\b", "u"), (r"\bUS\b", "us"), (r"(?i)\bcongress\b", "congress"), (r"(?i)\bfederal law\b", "federal law")),
}
# Per agency its entity, the letters and phrases that name it (any case), its domains.
AGENCIES = {
    "EEOC": ("agency_federal_eeoc", ("EEOC",), ("Equal Employment Opportunity Commission",), ("wage", "legal")),
    "CFPB": ("agency_federal_cfpb", ("CFPB",), ("Consumer Financial Protection Bureau", "Bureau of Consumer Financial Protection"), ("insurance", "legal")),
    "FTC": ("agency_federal_ftc", ("FTC",), ("Federal Trade Commission",), ("legal",)),
    "DOL": ("agency_federal_dol", ("DOL",), ("Department of Labor",), ("wage",)),
    "HUD": ("agency_federal_hud", ("HUD",), ("Housing and Urban Development",), ("housing",)),
    "SSA": ("agency_federal_ssa", ("SSA", "Social Security"), ("Social Security Administration",), ("benefits",)),
    "OSHA": ("agency_federal_osha", ("OSHA",), ("Occupational Safety and Health Administration",), ("wage",)),
    "NLRB": ("agency_federal_nlrb", ("NLRB",), ("National Labor Relations Board",), ("wage",)),
    "DFPI": ("agency_ca_dfpi", ("DFPI",), ("Department of Financial Protection and Innovation",), ("insurance", "legal")),
    "CRD": ("agency_ca_crd", ("CRD", "DFEH"), ("Civil Rights Department", "Department of Fair Employment and Housing"), ("housing", "wage", "legal")),
    "DLSE": ("agency_ca_dlse", ("DLSE",), ("Division of Labor Standards Enforcement", "Labor Commissioner"), ("wage",)),
    "EDD": ("agency_ca_edd", ("EDD",), ("Employment Development Department",), ("benefits",)),
}
# Patterns of deadlines (with a word that a match holds), addresses on the web, telephone numbers, streets and names of forms.
_UNIT = r"(\d+)\s+(business\s+days?|days?|weeks?|months?|years?)\b"
DEADLINES = (
    (rf"within\s+{_UNIT}", "within"),
    (rf"no\s+later\s+than\s+{_UNIT}", "later"),
    (rf"must\s+(?:file|submit|appeal|apply)\s+(?:your\s+)?(?:appeal|complaint|claim|application)?\s*within\s+{_UNIT}", "must"),
    (rf"deadline\s+(?:is|of|:)?\s*(?:no\s+later\s+than\s+)?{_UNIT}", "deadline"),
    (rf"appeal\s+within\s+{_UNIT}", "appeal"),
    (rf"file\s+(?:your\s+)?(?:appeal|complaint|claim)\s+within\s+{_UNIT}", "file"),
)
URLS = (r"""https?://[^\s<>"{}|\\^`\[\]]+""", r"""www\.[^\s<>"{}|\\^`]+""", r"""\b[a-zA-Z0-9.-]+\.(?:gov|org|com|edu|net|us)(?:/[^\s<>"{}|\\^`\[\]]*)?""")
URL = "|".join(URLS)
DOTTED = (".gov", ".org", ".com", ".edu", ".net", ".us", "www.", "http")
PHONE = r"(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"
STREET = r"\d+\s+[a-z0-9.'\-\s]+(?:st|street|ave|avenue|rd|road|blvd|boulevard|ln|lane|dr|drive|ct|court|pl|place|way|walk|circle|cir)\b"
NAMES = (
    r"\b([A-Z][A-Z0-9\s\-/&]{3,80}\b(?:FORM|COMPLAINT|APPEAL|APPLICATION|REQUEST|NOTICE|PETITION)\b[A-Z0-9\s\-/&]*)",
    r"(?i)\b((?:Form|Request|Application|Complaint|Appeal|Notice|Filing|Petition)\s+(?:No\.|#)?[A-Z0-9\-\s/&]{2,80})",
    r"\b([A-Z][A-Za-z\s\-/&]{2,80}\s+(?:Form|Complaint|Appeal|Application|Request|Notice|Petition))\b",
)
NAME_ACTIONS = ("apply", "file", "submit", "complaint", "appeal", "request")
GAPS = ("no_intake_form", "no_appeal_form", "no_escalation_path", "no_deadline_signal", "no_live_source_candidate")
ENGINE = "form_signals/3"
SPOT = "struct<kind:string,value:string,start:int,end:int>"
FOUND = "struct<value:string,confidence:double>"


def matches(text: Column, pattern: str, kind: str, needs: Column | None = None, value: str | None = None) -> Column:
    """Array of (kind, value, start, end) of a pattern's matches, in code points; value: what stands for all
    of them. needs: a condition without which there are none."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.expr(f"cast(array() as array<{SPOT}>)")
    pairs = F.slice(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("match"))), 1, F.size(found))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        said = F.trim(x["match"]) if value is None else F.lit(value)
        spot = F.struct(F.lit(kind).alias("kind"), said.alias("value"), start.alias("start"), (start + F.length(said)).alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(spot)).alias("out"))

    got = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    has = text.rlike(pattern) if needs is None else needs & text.rlike(pattern)
    return F.when(has, got).otherwise(none)


def scan(text: Column, low: Column | None = None) -> Column:
    """All matches of a text by place: urls, telephone numbers, streets, each word on actions and forms, also
    within one another, and deadlines. low: the text in lower case."""
    low = F.lower(text) if low is None else low
    digit = text.rlike("[0-9]")
    parts = [matches(text, p, "url", reduce(lambda a, b: a | b, (low.contains(d) for d in DOTTED))) for p in URLS]
    parts += [matches(text, PHONE, "phone", digit), matches(text, rf"(?i){STREET}[^.\n]*", "address", digit)]
    parts += [matches(text, rf"(?i)\b{w}\b", kind, low.contains(w), w) for kind, words in (("action_keyword", ACTIONS), ("form_indicator", INDICATORS)) for w in words]
    parts += [matches(text, f"(?i){p}", "deadline", digit & low.contains(word)) for p, word in DEADLINES]
    by_place = F.transform(F.array_distinct(F.concat(*parts)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.transform(F.array_sort(by_place), lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end")))


def blocks(spots: Column, length: Column, reach: int = 500) -> Column:
    """Array of (start, end): windows of ``reach`` around spots (by place), those that touch merged."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def step(acc, s):
        a, b = F.greatest(s["start"] - reach, F.lit(0)), F.least(s["end"] + reach, length)
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], b).alias("end"))))
        return F.when((F.size(acc) > 0) & (last["end"] >= a), joined).otherwise(F.concat(acc, F.array(F.struct(a.alias("start"), b.alias("end")))))

    return F.aggregate(spots, none, step)


def windows(spots: DataFrame, key: str, reach: int = 500) -> DataFrame:
    """Merged context windows around matches: key, start, end, n. Windows that touch are one. spots: key,
    start, end, length (of the text)."""
    x = spots.select(key, F.greatest(F.col("start") - reach, F.lit(0)).alias("a"), F.least(F.col("end") + reach, F.col("length")).alias("b"))
    order = W.partitionBy(key).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("_new", F.when(before.isNull() | (before < F.col("a")), 1).otherwise(0))
    x = x.withColumn("_i", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(key, "_i").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.count("*").alias("n")).drop("_i")


def _rows(counts: list[tuple[str, Column]], confidence, first: int = 0) -> Column:
    """(value, count) with a count above 0, as an array that sorts by confidence(count), surest first, then as
    listed. Counts are computed once."""
    there = F.filter(F.array(*(F.struct(n.alias("n"), F.lit(first + i).alias("i"), F.lit(value).alias("value")) for i, (value, n) in enumerate(counts))), lambda c: c["n"] > 0)
    return F.transform(there, lambda c: F.struct((-confidence(c["n"])).alias("o"), c["i"].alias("i"), c["value"].alias("value")))


def _ordered(rows: Column) -> Column:
    return F.transform(F.array_sort(rows), lambda c: F.struct(c["value"].alias("value"), (-c["o"]).alias("confidence")))


def _hits(low: Column, words) -> Column:
    """How many of words occur. One expression over an array, so that generated code stays small."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w)))


def candidates(low: Column, lists: dict, base: float, step: float, most: float) -> Column:
    """What has a word in a lower-case text, with a confidence that grows with the words found."""
    return _ordered(_rows([(name, _hits(low, words)) for name, words in lists.items()], lambda n: F.least(F.lit(most), base + step * n)))


def domains(low: Column) -> Column:
    return candidates(low, DOMAINS, 0.35, 0.15, 0.95)


def stages(low: Column) -> Column:
    return candidates(low, STAGES, 0.45, 0.15, 0.9)


def jurisdictions(text: Column, low: Column) -> Column:
    """By how many of a jurisdiction's patterns match."""
    count = lambda patterns: reduce(lambda a, b: a + b, ((low.contains(word) & text.rlike(p)).cast("int") for p, word in patterns))
    return _ordered(_rows([(name, count(patterns)) for name, patterns in JURISDICTIONS.items()], lambda n: F.least(F.lit(0.95), 0.5 + 0.2 * n)))


def workflows(low: Column, californian: Column) -> Column:
    """By groups of words that must all occur in a lower-case text; the first such group counts. Where
    ``californian`` holds, each is also one of that state's."""
    size = lambda groups: F.coalesce(F.size(F.get(F.filter(F.array(*(F.array(*map(F.lit, g)) for g in groups)), lambda g: F.forall(g, lambda w: low.contains(w))), F.lit(0))), F.lit(0))
    own = _rows([(name, size(groups)) for name, groups in WORKFLOWS.items()], lambda n: F.least(F.lit(0.95), 0.65 + 0.1 * n))
    state = lambda rows: F.transform(rows, lambda c: F.struct((-F.least(0.02 - c["o"], F.lit(0.97))).alias("o"), (c["i"] + len(WORKFLOWS)).alias("i"), F.concat(F.lit("ca_"), c["value"]).alias("value")))
    return let(own, lambda rows: _ordered(F.when(californian, F.concat(rows, state(rows))).otherwise(rows)))


def agencies(text: Column, low: Column) -> Column:
    """Agencies that a text names, as listed."""
    out = []
    for name, (_, letters, phrases, _) in AGENCIES.items():
        named = [low.contains(w.lower()) & text.rlike(rf"(?i)\b{w}\b") for w in letters] + [low.contains(p.lower()) for p in phrases]
        out.append((name, reduce(lambda a, b: a | b, named).cast("int")))
    return _ordered(_rows(out, lambda n: F.lit(0.9)))


def deadline(text: Column, low: Column | None = None) -> Column:
    """What the first of the patterns that occurs says: (text, value, unit, days, confidence); null if none
    does."""
    low = F.lower(text) if low is None else low
    got = F.coalesce(*(F.when(low.contains(word), F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit(""))) for p, word in DEADLINES))

    def said(found):
        unit = F.lower(F.regexp_extract(found, f"(?i){_UNIT}", 2))
        n = F.regexp_extract(found, f"(?i){_UNIT}", 1).try_cast("int")
        days = n * F.when(unit.contains("day"), 1).when(unit.startswith("week"), 7).when(unit.startswith("month"), 30).when(unit.startswith("year"), 365).otherwise(1)
        one = F.struct(found.alias("text"), n.alias("value"), unit.alias("unit"), days.alias("days"), F.when(unit.contains("business"), 0.75).otherwise(0.85).alias("confidence"))
        return F.when(found.isNotNull(), one)

    return let(got, said)


def method(text: Column, low: Column) -> Column:
    dotted = reduce(lambda a, b: a | b, (low.contains(d) for d in DOTTED))
    digit = text.rlike("[0-9]")
    return F.when(dotted & low.rlike(r"https?://|www\.|\.(?:gov|org|com|edu|net|us)\b"), "online").when(digit & text.rlike(PHONE), "phone").when(digit & text.rlike(f"(?i){STREET}"), "mail_or_in_person").otherwise("unknown")


def form_name(text: Column) -> Column:
    """(name, strategy): a name in the text itself; else a heading around the first line with an address on
    the web; else a label in the five lines before a word on actions. Null if none is there."""
    explicit = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in NAMES))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)https?://|www\.|\.(?:gov|org|com|edu|net|us)\b")), F.lit(True)).cast("int")
    first = F.greatest(at - 4, F.lit(1))
    near = F.when(at > 0, F.get(F.filter(F.slice(lines, first, at + 2 - first), lambda x: x.rlike(r"^[A-Z][A-Za-z0-9\s\-/&]{5,90}$")), F.lit(0)))
    word = rf"(?i)\b(?:{'|'.join(NAME_ACTIONS)})\b"
    # each line beside the five before it
    beside = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.slice(lines, F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5))).alias("before")))
    label = F.transform(F.filter(beside, lambda b: b["line"].rlike(word)), lambda b: F.get(F.filter(b["before"], lambda p: p.rlike("^[A-Z]") & (F.length(p) > 5) & (F.length(p) < 100)), F.lit(0)))
    label = F.get(F.array_compact(label), F.lit(0))
    pair = lambda c, how: let(c, lambda x: F.when(x.isNotNull(), F.struct(squeezed(x).alias("name"), F.lit(how).alias("strategy"))))
    return F.coalesce(pair(explicit, "explicit_form_heading"), F.when(text.contains("\n"), F.coalesce(pair(near, "heading_near_url"), pair(label, "label_before_action"))))


def forms(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    """A form record for each text: what was found, its confidence (0 to 6), review status and flags."""
    t, low = F.col("__text"), F.col("__low")
    rest = [c for c in texts.columns if c != text_col]
    url = F.when(reduce(lambda a, b: a | b, (low.contains(d) for d in DOTTED)), F.nullif(F.regexp_replace(F.regexp_extract(t, f"(?i){URL}", 0), r"[).,;:]+$", ""), F.lit("")))
    x = texts.select(*rest, F.col(text_col).alias("__text"), F.lower(text_col).alias("__low"))
    x = x.select(*rest, "__text", "__low", url.alias("url"), form_name(t).alias("__name"), jurisdictions(t, low).alias("jurisdictions"), agencies(t, low).alias("agencies"), domains(low).alias("domains"), stages(low).alias("stages"), deadline(t, low).alias("d"), method(t, low).alias("method"))
    x = x.select(
        *rest, "url", web_address(F.col("url")).alias("normalized_url"), F.col("__name.name").alias("form_name"), F.col("__name.strategy").alias("strategy"), workflows(low, F.exists("jurisdictions", lambda j: j["value"] == "CA")).alias("workflows"),
        "agencies", "domains", "stages", "jurisdictions", "d", "method", F.substring(squeezed(t), 1, 500).alias("excerpt"))
    has = lambda c: c.cast("double")
    score = has(F.col("normalized_url").isNotNull()) + has(F.size("workflows") > 0) + has(F.size("agencies") > 0) + has(F.size("domains") > 0) + has(F.col("form_name").isNotNull()) + 0.5 * has(F.col("d.days").isNotNull()) + 0.5 * has(F.size("stages") > 0)
    x = x.withColumn("confidence", F.coalesce(F.least(score, F.lit(6.0)), F.lit(0.0)))
    status = F.when((F.col("confidence") >= 4) & F.col("normalized_url").isNotNull() & (F.size("agencies") > 0), "pending_live_verification").when(F.col("confidence") >= 2, "pending_review").otherwise("pending_enrichment")
    flags = {
        "missing_url": F.col("normalized_url").isNull(), "missing_agency": F.size("agencies") <= 0, "missing_workflow": F.size("workflows") <= 0, "missing_domain": F.size("domains") <= 0, "low_confidence": F.col("confidence") < 2,
        "multiple_domains": F.size("domains") > 1, "multiple_workflows": F.size("workflows") > 1, "multiple_agencies": F.size("agencies") > 1, "has_deadline": F.col("d.days").isNotNull(), "deadline_unit_not_days": F.col("d.unit").isNotNull() & ~F.col("d.unit").contains("day"),
        "ambiguous_jurisdiction": F.size("jurisdictions") > 1, "requires_live_url_verification": F.col("normalized_url").isNotNull(), "requires_registry_entity_resolution": F.lit(False)}
    return x.withColumn("status", status).withColumn("flags", F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items()))), ","))


def text_sources(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """source, id, text of tables (frame, id column, text column) that forms are looked for in; empty texts are
    left out."""
    parts = [df.select(F.lit(name).alias("source"), F.col(i).cast("string").alias("id"), F.col(t).cast("string").alias("text")) for name, (df, i, t) in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).where(squeezed(F.col("text")).isNotNull())


KEY = ("normalized_url", "form_key", "agency", "workflow", "stage")


def extracted(texts: DataFrame, key: str, text_col: str, reach: int = 500) -> DataFrame:
    """Form records of texts: one for each block of context, those of a text with one composite key as one.
    key, form_id, start, end and the columns of ``forms``."""
    text = F.col("__t")
    x = texts.select(F.col(key), F.col(text_col).alias("__t")).withColumn("__spots", scan(text))
    x = x.withColumn("__b", F.explode(blocks(F.col("__spots"), F.length(text), reach)))
    x = x.select(key, F.col("__b.start").alias("start"), F.col("__b.end").alias("end"), F.sha2(text.cast("binary"), 256).alias("source_hash"), F.substring(text, F.col("__b.start") + 1, F.col("__b.end") - F.col("__b.start")).alias("__part"))
    x = forms(x.withColumn("context_hash", joined_hash(F.col("source_hash"), F.col("start"), F.col("end"), F.col("__part"))), key, "__part")
    x = x.withColumn("form_id", joined_hash(F.col("source_hash"), F.col("context_hash"), F.lit(ENGINE)))
    x = x.withColumn("form_key", F.lower(F.regexp_replace("form_name", "[^A-Za-z0-9]+", "_")))
    first = lambda c: F.get(F.col(c), F.lit(0))["value"]
    x = x.withColumn("agency", first("agencies")).withColumn("workflow", first("workflows")).withColumn("stage", first("stages")).withColumn("domain", first("domains")).withColumn("jurisdiction", first("jurisdictions"))
    return deduplicated(x, [key, *KEY], "start")


def deduplicated(rows: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """One form for each composite key: the surest (then the smallest ``tie``), with everyone's candidates
    and how many there were. One aggregation, so that rows are computed and dealt once."""
    lists = [c for c in ("domains", "workflows", "agencies", "jurisdictions", "stages") if c in rows.columns]
    others = [c for c in rows.columns if c not in (*keys, *lists)]
    order = F.struct(F.col("confidence").isNull(), -F.col("confidence"), F.col(tie))
    everyone = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)
    x = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("__best"), F.count("*").alias("group_size"), *map(everyone, lists))
    return x.select(*(F.col(c) if c in keys else F.col(f"__best.{c}") for c in rows.columns if c not in lists), "group_size", *lists)


def review_priority(days: Column, confidence: Column, url: Column, flags: Column) -> Column:
    """A near deadline first; then what is sure and has an address, or lacks a workflow or an agency."""
    lacks = flags.contains("missing_workflow") | flags.contains("missing_agency")
    return F.when(days <= 30, "high").when((confidence >= 4) & url.isNotNull(), "medium").when(lacks, "medium").otherwise("low")


def staging(records: DataFrame, key: str, run_id: str) -> dict[str, DataFrame]:
    """The seven tables that reviewers and later stages read, from what ``extracted`` gives."""
    facts = F.create_map(*(F.lit(v) for name, (entity, _, _, _) in AGENCIES.items() for v in (name, entity)))
    own = F.create_map(*(v for name, (_, _, _, domains_) in AGENCIES.items() for v in (F.lit(name), F.lit(",".join(domains_)))))
    each = lambda c: records.select(key, "form_id", F.explode(c).alias("c")).select(key, "form_id", "c.*")
    state = F.col("value").startswith("ca_")
    reasons = F.regexp_replace("flags", ",", ", ")
    return {
        "forms": records.select(key, "form_id", F.lit(run_id).alias("run_id"), "form_name", "strategy", "form_key", "url", "normalized_url", "method", "agency", facts[F.col("agency")].alias("agency_entity"), "jurisdiction", F.col("domain").alias("primary_domain"),
                                F.col("workflow").alias("primary_workflow"), F.col("stage").alias("primary_stage"), F.col("d.days").alias("deadline_days"), F.col("d.unit").alias("deadline_unit"), "confidence", "status", "flags", "context_hash", "source_hash", "excerpt"),
        "agencies": each("agencies").select(key, "form_id", F.col("value").alias("agency"), facts[F.col("value")].alias("agency_entity"), own[F.col("value")].alias("domains"), "confidence"),
        "workflows": each("workflows").select(key, "form_id", F.col("value").alias("workflow"), "confidence", state.alias("of_state"), F.when(state, F.substring("value", 4, 200)).otherwise(F.col("value")).alias("base_workflow")),
        "domains": each("domains").select(key, "form_id", F.col("value").alias("domain"), "confidence"),
        "deadlines": records.where("d.days is not null").select(key, "form_id", F.col("d.text").alias("text"), F.col("d.value").alias("value"), F.col("d.unit").alias("unit"), F.col("d.days").alias("days"), F.col("d.confidence").alias("confidence"), F.lit(True).alias("requires_legal_verification")),
        "provenance": records.select(key, "form_id", F.lit(run_id).alias("run_id"), "source_hash", "context_hash", "start", "end", F.lit(ENGINE).alias("engine"), F.lit(True).alias("deterministic")),
        "reviews": records.where("flags <> ''").select(key, "form_id", "status", "flags", "confidence", review_priority(F.col("d.days"), F.col("confidence"), F.col("normalized_url"), F.col("flags")).alias("priority"), reasons.alias("reason")),
    }


def statistics(records: DataFrame, least: float = 2.0) -> DataFrame:
    """group, name, n: records by domain, workflow, jurisdiction and status, all, and those sure enough; and
    their average confidence as a thousandfold whole number."""
    as_group = lambda group, c: F.transform(c, lambda v: F.struct(F.lit(group).alias("group"), v["value"].alias("name")))
    listed = F.concat(as_group("domain", "domains"), as_group("workflow", "workflows"), as_group("jurisdiction", "jurisdictions"))
    status = F.array(F.struct(F.lit("status").alias("group"), F.col("status").alias("name")))
    by = records.select(F.inline(F.concat(listed, status))).groupBy("group", "name").agg(F.count("*").alias("n"))
    whole = records.agg(F.count("*").alias("all"), F.count_if(F.col("confidence") >= least).alias("sure"), F.round(F.avg("confidence") * 1000).cast("long").alias("mean"))
    rows = F.array(*(F.struct(F.lit("total").alias("group"), F.lit(n).alias("name"), F.col(c).alias("n")) for n, c in (("forms", "all"), ("high_confidence", "sure"), ("mean_confidence_milli", "mean"))))
    return by.union(whole.select(F.inline(rows)))


def coverage(records: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """expected workflows (by default all, and all as a state's) with n, and which of GAPS each has."""
    spark = records.sparkSession
    expected = expected or [*WORKFLOWS, *(f"ca_{w}" for w in WORKFLOWS)]
    staged = lambda *s: F.exists("stages", lambda x: x["value"].isin(*s))
    name = F.lower(F.coalesce("form_name", F.lit("")))
    have = (staged("intake") | (F.size("domains") > 0), staged("appeal") | name.contains("appeal"), staged("hearing", "escalation") | name.rlike("hearing|grievance|ombudsman"), F.col("d.days").isNotNull(), F.col("normalized_url").isNotNull())
    got = records.select(F.explode("workflows").alias("w"), *(c.alias(g) for g, c in zip(GAPS, have))).groupBy(F.col("w.value").alias("workflow")).agg(F.count("*").alias("n"), *(F.bool_or(g).alias(g) for g in GAPS))
    x = spark.createDataFrame([(e,) for e in expected], "workflow string").join(got, "workflow", "left").na.fill(0, ["n"])
    gaps = F.array_compact(F.array(*(F.when(~F.coalesce(F.col(g), F.lit(False)), F.lit(g)) for g in GAPS)))
    return x.select("workflow", "n", F.array_join(gaps, ",").alias("gaps"))
