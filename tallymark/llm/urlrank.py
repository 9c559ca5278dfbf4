"""Verdicts on urls: rules of host and path first, then propagation over the graph of hosts.

Hosts are those of pages and those that pages link to, crawled or not. Host edges are links between hosts in
the pages' html (counted before they are shuffled) and the bond of a host with its parent host where both
occur. Trust is personalised PageRank from hosts in proportion to the share of their pages that a rule
allows; distrust runs over reversed edges, from hosts by the share that a rule blocks: who links to blocked
hosts is suspect. A host without pages is a seed where a rule for all paths decides it by its name. A host is
blocked when its distrust is at least ``THRESHOLD`` of trust, distrust and an even share for each host together.

Ranks are moved until an iteration changes them by less than ``TOLERANCE`` of an even share in sum, after which
no host's rank can change by more than 0.6 % of an even share; more than ``MOST_ITERATIONS`` are an error.
Everything is DataFrame operations; ranks are written to the shared folder each iteration.

Defined results: a url that is null or has no ``://`` has empty host and path and, as no rule and no
evidence touches it, verdict allow; null html has no links; repeated rows give a row each and count as
pages of their host; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, stored, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, THRESHOLD = 0.85, 0.5
TOLERANCE, MOST_ITERATIONS = 1e-3, 400
ROUNDED = 5  #: places of the share that is held against THRESHOLD: sums may differ beyond them
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with rule and its verdict, by columns host and path; the longest rule wins."""
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("by_rule", verdict)


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between hosts. pages: host, html."""
    target = lambda u: host_of(F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))
    found = F.explode(F.transform(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)), target)).alias("dst")
    return pages.where(F.col("html").contains("//") & (F.col("host") != "")).select(F.col("host").alias("src"), found).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def seeded(parsed: DataFrame, links: DataFrame, rules=RULES) -> DataFrame:
    """host, good, bad: every host and its seed weights. parsed: host, by_rule of each page."""
    share = lambda kind: F.count_if(F.col("by_rule") == kind) / F.count("*")
    own = parsed.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    # of a host without pages only the rules for all paths can say something, as other rules' paths are longer
    named = with_rule(links.select(F.col("dst").alias("host")).distinct().withColumn("path", F.lit("/")), [r for r in rules if r[2] in ("", "/")])
    named = named.join(own, "host", "left_anti").select("host", *(F.coalesce((F.col("by_rule") == kind).cast("double"), F.lit(0.0)) for kind in ("allow", "block")))
    return own.union(named)


def host_edges(links: DataFrame, hosts: DataFrame) -> DataFrame:
    """src, dst, n: links, and the bonds of hosts with their parent hosts."""
    known = hosts.select(F.col("host").alias("dst"))
    kin = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")).where("instr(src, '.') > 0").join(known, "dst").select("src", "dst")
    kin = kin.union(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("n", F.lit(1.0))
    return links.union(kin).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most: int = MOST_ITERATIONS) -> DataFrame:
    """host, trust, distrust. hosts: host, good, bad (seed weights)."""
    total = hosts.agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    seeds = hosts.crossJoin(F.broadcast(total)).select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.try_divide("good", "g").alias("seed")), F.struct(F.lit("d").alias("kind"), F.try_divide("bad", "b").alias("seed")))).alias("x")).select("host", "x.kind", F.coalesce("x.seed", F.lit(0.0)).alias("seed"))
    seeds = stored(seeds, "seeds")
    both = edges.select(F.lit("t").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("d"), F.col("dst"), F.col("src"), F.col("n")))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    shares = stored(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")
    ranks = seeds.select("host", "kind", "seed", F.col("seed").alias("rank"), F.lit(1.0).alias("change"))
    done = shares.isEmpty()
    enough = tolerance / max(1, hosts.count())
    for _ in range(most):
        if done:
            break
        moved = shares.join(ranks.select(F.col("host").alias("src"), "kind", "rank").where("rank > 0"), ["kind", "src"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        # hosts without edges keep nothing: what they held returns to the seeds
        kept = moved.groupBy("kind").agg(F.sum("got").alias("kept"))
        rank = F.lit(damping) * F.coalesce("got", F.lit(0.0)) + F.col("seed") * (1 - damping * F.coalesce("kept", F.lit(0.0)))
        new = ranks.drop("change").join(moved, ["kind", "host"], "left").join(F.broadcast(kept), "kind", "left").select("host", "kind", "seed", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("change"))
        old, ranks = ranks, stored(new, "ranks")
        if hasattr(old, "_scratch"):
            forget(old)
        done = (ranks.agg(F.sum("change")).first()[0] or 0.0) <= enough
    if not done:
        raise RuntimeError(f"ranks did not settle in {most} iterations")
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "t", F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == "d", F.col("rank"))).alias("distrust"))


def judged(pages: DataFrame, rules=RULES, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", threshold: float = THRESHOLD) -> DataFrame:
    """id, host, path, rule, verdict, trust, distrust of every row."""
    url = F.col(url_col).cast("string")
    parsed = with_rule(pages.select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).cast("string").alias("html")), rules)
    links = stored(host_links(parsed.select("host", "html")), "host-links")
    hosts = stored(seeded(parsed.select("host", "by_rule"), links, rules), "hosts")
    edges = stored(host_edges(links, hosts), "edges")
    even = hosts.agg((1 / F.greatest(F.count("*"), F.lit(1))).alias("even"))
    scored = propagate(hosts, edges).crossJoin(F.broadcast(even)).select("host", "trust", "distrust", (F.round(F.col("distrust") / (F.col("trust") + F.col("distrust") + F.col("even")), ROUNDED) >= threshold).alias("bad"))
    scored = stored(scored, "scored")
    return parsed.drop("html").join(scored, "host", "left").select(
        id_col, "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op6_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle_sql(pages: str = "pages", steps: int = 200) -> str:
    fits = lambda h, p: f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in longest) + " END"
    kind = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{k}'" for k, h, p in longest) + " END"
    href = _HREF.replace("'", "''")
    low = f"'{_UPPER}', '{_LOWER}'"
    general = "CASE " + " ".join(f"WHEN host = '{h}' OR host LIKE '%.{h}' THEN '{k}'" for k, h, p in longest if p in ("", "/")) + " END"
    return f"""
WITH RECURSIVE u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {low}) AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, html FROM {pages}),
p AS (SELECT *, {rule} AS rule, {kind} AS by_rule FROM u),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS url FROM p WHERE host <> ''),
links AS (SELECT src, dst, count(*) AS n FROM (SELECT src, translate(regexp_extract(CASE WHEN starts_with(url, '//') THEN 'http:' || url ELSE url END, '://([^/?#]*)', 1), {low}) AS dst FROM l)
  WHERE src <> dst AND dst <> '' GROUP BY src, dst),
own AS (SELECT host, count(*) FILTER (by_rule = 'allow') / count(*) AS good, count(*) FILTER (by_rule = 'block') / count(*) AS bad FROM p WHERE host <> '' GROUP BY host),
named AS (SELECT host, {general} AS g FROM (SELECT DISTINCT dst AS host FROM links) WHERE host NOT IN (SELECT host FROM own)),
hosts AS (SELECT * FROM own UNION ALL SELECT host, CASE WHEN g = 'allow' THEN 1 ELSE 0 END, CASE WHEN g = 'block' THEN 1 ELSE 0 END FROM named),
kin AS (SELECT h.host AS src, k.host AS dst FROM hosts h JOIN hosts k ON k.host = substr(h.host, instr(h.host, '.') + 1) WHERE instr(h.host, '.') > 0),
edges AS (SELECT src, dst, sum(n) AS n FROM (SELECT src, dst, n FROM links UNION ALL SELECT src, dst, 1 FROM kin UNION ALL SELECT dst, src, 1 FROM kin) GROUP BY src, dst),
both_ways AS (SELECT 't' AS kind, src, dst, n FROM edges UNION ALL SELECT 'd', dst, src, n FROM edges),
shares AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
r0 AS (SELECT 't' AS kind, host, coalesce(good / nullif((SELECT sum(good) FROM hosts), 0), 0) AS rank FROM hosts
  UNION ALL SELECT 'd', host, coalesce(bad / nullif((SELECT sum(bad) FROM hosts), 0), 0) FROM hosts),
ranks AS (SELECT 0 AS i, kind, host, rank FROM r0 UNION ALL
  SELECT x.i + 1, x.kind, x.host, {DAMPING} * coalesce(x.got, 0) + s.rank * (1 - {DAMPING} * sum(coalesce(x.got, 0)) OVER (PARTITION BY x.kind)) FROM (
    SELECT max(r.i) AS i, r.kind, coalesce(e.dst, r.host) AS host, sum(e.share * r.rank) AS got
    FROM (SELECT * FROM ranks WHERE i < {steps}) r LEFT JOIN (SELECT kind, src, dst, share FROM shares UNION ALL SELECT kind, host, host, 0 FROM r0) e ON e.kind = r.kind AND e.src = r.host GROUP BY r.kind, coalesce(e.dst, r.host)) x
  JOIN r0 s ON s.kind = x.kind AND s.host = x.host),
f AS (SELECT host, sum(rank) FILTER (kind = 't') AS t, sum(rank) FILTER (kind = 'd') AS d FROM ranks WHERE i = {steps} GROUP BY host)
SELECT p.page_id, p.host, p.path, p.rule, coalesce(p.by_rule, CASE WHEN round(f.d / (f.t + f.d + 1.0 / (SELECT count(*) FROM hosts)), {ROUNDED}) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (host)"""


ORACLES = {"op6_url_verdicts": oracle_sql()}
QUERIES = {"op6_url_verdicts": op6_url_verdicts}
