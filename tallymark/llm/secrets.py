"""Secrets in texts, as spans of code points, in DataFrame expressions alone.

Base kinds are regular expressions, leftmost and non-overlapping by kind; a match that fails its
length rule is dropped after it has been consumed. The method adds ``entropy`` spans: strings of at
least ``WINDOW`` base-64 or hex signs over which a window slides, one sign in and one sign out, with
the counts of the signs and the sum of c*log2(c) kept up to date; a string is a finding when some
window's Shannon entropy reaches the bound of the string's character class, unless it is on the
allow list or overlaps a base span.

Defined results: null is the empty text; no spans give the empty string and its digest; repeated rows
give a row each; an empty table gives no rows; extra columns are dropped. Places of matches come from
the lengths of what lies between them, so all of a text is searched, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WINDOW = 20
CHUNK = 1024  #: code points
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: bits that a window must have, by the narrowest class that holds the whole string
CLASSES = ((r"^[0-9a-f]+$|^[0-9A-F]+$", 3.0), (r"^[A-Z0-9]+$|^[a-z0-9]+$", 3.6), (r"^[A-Za-z0-9]+$", 3.8), (r".", 3.9))
ALLOWED = (
    r"^[A-Za-z/_=+-]+$",  # no digit: words, rules and paths of words
    r"^[0-9/_=+-]+$",  # no letter: numbers, dates, rules
    r"^[A-Za-z]+[0-9]{1,4}$",  # a word and a number
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx",
    r"(?i)abcdefghij|0123456789|1234567890",
    r"^([A-Za-z]+[-_/])+[A-Za-z0-9]{1,12}$",  # slugs
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def let(value: Column, then) -> Column:
    """then(value), with value computed once. Columns named within a lambda may be computed anew for
    each item, as they may stand for expressions by then; a lambda's arguments are not."""
    return F.transform(F.array(value), then)[0]


def scanned(items: Column, zero: Column, step, of: str) -> Column:
    """The running states of step(state, item) after each item; of: the states' type. Appending to an array
    copies it, so states are gathered in blocks of about the root of their number, and blocks by reference."""
    n = F.size(items)
    none, nones = F.expr(f"cast(array() as array<{of}>)"), F.expr(f"cast(array() as array<array<{of}>>)")
    width = lambda n: F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))

    def inner(acc: Column, x: Column) -> Column:
        state = step(acc["last"], x)
        return F.struct(state.alias("last"), F.concat(acc["out"], F.array(state)).alias("out"))

    def outer(acc: Column, k: Column) -> Column:
        own = F.slice(acc["items"], k * acc["width"] + 1, acc["width"])
        done = F.aggregate(own, F.struct(acc["last"].alias("last"), none.alias("out")), inner)
        # one block, made once: its last state is the next block's first
        return let(done, lambda d: F.struct(d["last"].alias("last"), F.concat(acc["out"], F.array(d["out"])).alias("out"), acc["items"].alias("items"), acc["width"].alias("width")))

    start = F.struct(zero.cast(of).alias("last"), nones.alias("out"), items.alias("items"), width(n).alias("width"))
    found = F.aggregate(F.sequence(F.lit(0), F.ceil(n / width(n)).cast("int") - 1), start, outer, lambda acc: F.flatten(acc["out"]))
    return F.when(n > 0, found).otherwise(none)


def _spans(found: Column, gaps: Column, kind: int, keep=None, values: Column | None = None) -> Column:
    """Spans of found, which lie between gaps. keep(match, value): whether a match counts."""
    sizes = F.slice(F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("own"))), 1, F.size(found))
    ends = scanned(sizes, F.lit(0), lambda at, x: at + x["gap"] + x["own"], "int")
    spans = F.zip_with(ends, found, lambda end, m: F.struct((end - F.length(m)).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), m.alias("match")))
    both = F.zip_with(spans, found if values is None else values, lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    both = F.filter(both, lambda x: keep(x["s"]["match"], x["v"])) if keep else both
    return F.transform(both, lambda x: F.struct(x["s"]["start"].alias("start"), x["s"]["kind"].alias("kind"), x["s"]["end"].alias("end")))


def _xlog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits, of a window of signs of ALPHABET."""
    places = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"), places.alias("p"))

    def step(acc: Column, i: Column) -> Column:
        come = acc["p"][i]
        go = F.when(i >= window, acc["p"][i - window]).otherwise(F.lit(-1))
        n_in = acc["n"][come]
        n_out = F.when(go >= 0, acc["n"][F.greatest(go, F.lit(0))] + (go == come).cast("int")).otherwise(F.lit(0))
        s = acc["s"] - _xlog(n_in) + _xlog(n_in + 1) - _xlog(n_out) + _xlog(n_out - 1)
        n = F.transform(acc["n"], lambda c, j: c + (j == come).cast("int") - (j == go).cast("int"))
        bits = F.log2(F.lit(float(window))) - s / window
        return F.struct(n.alias("n"), s.alias("s"), F.when(i >= window - 1, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"), acc["p"].alias("p"))

    return F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), start, step, lambda acc: acc["best"])


def is_random(text: Column) -> Column:
    """Whether a candidate string is a finding."""
    bound = F.lit(None).cast("double")
    for pattern, bits in reversed(CLASSES):
        bound = F.when(text.rlike(pattern), F.lit(bits)).otherwise(bound)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | text.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(F.round(window_entropy(text), 9) >= bound)


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with arrays ``out`` (all) and ``out``_base of structs (start, kind, end), sorted."""
    text = F.col("__sp_text")
    none = F.expr("cast(array() as array<string>)")
    df = docs.withColumn("__sp_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    for name, pattern, hint in (("assign", ASSIGN, text.rlike(ASSIGN)), ("access", ACCESS, text.contains("AKIA") & text.rlike(ACCESS)), ("hex", HEX, text.rlike(HEX)), ("cand", CANDIDATE, text.rlike(CANDIDATE))):
        df = df.withColumn(f"__sp_has_{name}", hint)
        df = df.withColumn(f"__sp_m_{name}", F.when(F.col(f"__sp_has_{name}"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
        df = df.withColumn(f"__sp_g_{name}", F.when(F.col(f"__sp_has_{name}"), F.split(text, pattern, -1)).otherwise(none))
    df = df.withColumn("__sp_v", F.when(F.col("__sp_has_assign"), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))).otherwise(none))
    base = F.concat(
        _spans(F.col("__sp_m_assign"), F.col("__sp_g_assign"), 0, lambda m, v: F.length(v) >= 6, F.col("__sp_v")),
        _spans(F.col("__sp_m_access"), F.col("__sp_g_access"), 1),
        _spans(F.col("__sp_m_hex"), F.col("__sp_g_hex"), 2),
    )
    df = df.withColumn("__sp_base", F.array_sort(base))
    df = df.withColumn("__sp_extra", _spans(F.col("__sp_m_cand"), F.col("__sp_g_cand"), 3, lambda m, v: is_random(m)))
    # both kinds by place: a finding overlaps a base span if one before it ends after its start, or the next begins before its end
    df = df.withColumn("__sp_all", F.array_sort(F.concat("__sp_base", "__sp_extra")))
    is_base = lambda s: s["kind"] != 3
    reach = scanned(F.col("__sp_all"), F.lit(0), lambda at, s: F.when(is_base(s), F.greatest(at, s["end"])).otherwise(at), "int")
    ahead = F.reverse(scanned(F.reverse("__sp_all"), F.lit(2**31 - 1), lambda at, s: F.when(is_base(s), s["start"]).otherwise(at), "int"))
    around = F.zip_with(reach, ahead, lambda r, a: F.struct(r.alias("reach"), a.alias("ahead")))
    alone = F.filter(F.zip_with("__sp_all", around, lambda s, x: F.struct(s.alias("s"), x.alias("x"))), lambda y: is_base(y["s"]) | ((y["x"]["reach"] <= y["s"]["start"]) & (y["x"]["ahead"] >= y["s"]["end"])))
    df = df.withColumn("__sp_all", F.when((F.size("__sp_extra") > 0) & (F.size("__sp_base") > 0), F.transform(alone, lambda y: y["s"])).otherwise(F.col("__sp_all")))
    keep = [c for c in docs.columns if c not in (out, f"{out}_base")]
    return df.select(*(F.col(f"`{c}`") for c in keep), F.col("__sp_base").alias(f"{out}_base"), F.col("__sp_all").alias(out))


def _joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mark; null texts stay null."""
    df = with_spans(docs, text_col, "__sp_found")
    text, found = F.col(text_col), F.col("__sp_found")

    def cut(chunks: Column, start: Column, end: Column) -> Column:
        a, b = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        head = F.substring(F.get(chunks, a), start - a * CHUNK + 1, F.lit(CHUNK))
        middle = F.when(b - a > 1, F.array_join(F.slice(chunks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")).otherwise(F.lit(""))
        tail = F.substring(F.coalesce(F.get(chunks, b), F.lit("")), F.lit(1), end - b * CHUNK)
        return F.when(a == b, F.substring(F.get(chunks, a), start - a * CHUNK + 1, end - start)).otherwise(F.concat(head, middle, tail))

    def replaced(x: Column) -> Column:
        some = lambda start, end: F.when(start < end, cut(x["chunks"], start, end)).otherwise(F.lit(""))
        before = F.slice(F.concat(F.array(F.lit(0)), x["past"]), 1, F.size(x["found"]))  # where the text before each span begins
        pieces = F.zip_with(x["found"], before, lambda s, at: F.when(s["start"] >= at, F.concat(some(at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(pieces, ""), some(F.element_at(x["past"], -1), x["size"]))

    # pieces are cut from chunks, as a place in a whole text is found by counting from its start
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    past = scanned(found, F.lit(0), lambda at, s: F.greatest(at, s["end"]), "int")
    done = let(F.struct(chunks.alias("chunks"), past.alias("past"), found.alias("found"), F.length(text).alias("size")), replaced)
    return df.withColumn(text_col, F.when(F.size(found) > 0, done).otherwise(text)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans_base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined("spans_base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def oracle_sql(docs: str = "documents") -> str:
    """The same in DuckDB's list functions; entropy by list_entropy of each window."""
    q = lambda s: s.replace("'", "''")
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

    def spans(kind: int, pattern: str, keep: str = "true") -> str:
        m, g = f"regexp_extract_all(t, '{q(pattern)}')", f"string_split_regex(t, '{q(pattern)}')"
        start = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        return f"""SELECT doc_id, rid, {kind} AS kind, {start} AS s, {start} + length(m[i]) AS e, m[i] AS hit FROM (
  SELECT doc_id, rid, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, rid, {m} AS m, {g} AS g FROM d WHERE regexp_matches(t, '{q(pattern)}'))) WHERE {keep.replace('HIT', 'm[i]')}"""

    allowed = " OR ".join(f"regexp_matches(hit, '{q(p)}')" for p in ALLOWED)
    bound = "CASE " + " ".join(f"WHEN regexp_matches(hit, '{q(p)}') THEN {b}" for p, b in CLASSES) + " END"
    entropy = f"list_max(list_transform(range(1, length(hit) - {WINDOW} + 2), lambda i: round(list_entropy(string_split(substr(hit, i, {WINDOW}), '')), 9)))"
    name = "[" + ", ".join(f"'{k}'" for k in KINDS) + "][kind + 1]"
    line = f"string_agg({name} || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind)"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM {docs}),
base AS (
  {spans(0, assign, f"length(regexp_extract(HIT, '{q(assign)}', 1)) >= 6")}
  UNION ALL {spans(1, ACCESS)}
  UNION ALL {spans(2, HEX)}),
cand AS ({spans(3, CANDIDATE)}),
extra AS (SELECT * FROM cand c WHERE NOT ({allowed}) AND {entropy} >= {bound}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = c.rid AND b.s < c.e AND c.s < b.e)),
per_base AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, {line} AS line FROM base GROUP BY rid),
per_all AS (SELECT rid, {line} AS line FROM (SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY rid)
SELECT d.doc_id, CAST(coalesce(b.a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b.k, 0) AS BIGINT) AS n_access, CAST(coalesce(b.h, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(b.line, '')) AS base_sha256, coalesce(p.line, '') AS spans
FROM d LEFT JOIN per_base b USING (rid) LEFT JOIN per_all p USING (rid)"""


ORACLES = {"op5_secrets": oracle_sql()}
QUERIES = {"op5_secrets": op5_secrets}
