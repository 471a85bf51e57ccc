"""URL filters: rules, and for the rest the propagation of trust and distrust over host links. DataFrame functions only.

Rules (host, path) fit a host and its subdomains where the path begins with the rule's; the longest wins. A url that no
rule fits gets its host's verdict. A seed's mass is the share of its pages that the rules allow (trust) or block (distrust).

Trust is personalised PageRank from the allowed hosts along their links; what arrives at hosts without links goes back to the seeds by their mass, so
the sum of all trust is that of all mass, and a host without any links has its mass. Distrust goes against the links: a host has its own blocked mass,
and for the rest DAMPING times the mean distrust of what it links to, weighted by its own links. So it is at most 1, and doesn't depend on how many other hosts link
to a blocked one. A host is blocked if its distrust is at least THRESHOLD and above its trust.

Pages of a host are counted map-side before they move, links are counted by pair of hosts; a hot host is one row then, and
the join that hands hosts' verdicts to pages may be split by AQE. Rounds write the scores (a row a host) to the shared
folder and end when no score moves by more than EPSILON; each round shrinks what is missing by DAMPING. A lost executor costs its running tasks.

Defined results: null url, or one without `://`, has empty host and path, fits no rule and is allowed; null html has no
links; links of a page to its own host don't count; repeated rows each get a row, and count as pages of their host; scores are rounded to 9 digits before
they are held against the threshold; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored, table

DAMPING, EPSILON, THRESHOLD = 0.85, 1e-6, 0.5
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Host of a link. Possessive, so that a run of blanks is read once; PLAIN means the same without.
LINK = "(?i)(?:href|src)\\s*+=\\s*+[\"']?+\\s*+(?:[a-z][a-z0-9+.-]*+:)?+//([^/?#\"'\\s<>]+)"
PLAIN = LINK.replace("*+", "*").replace("?+", "?")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. The list of rules is part of the plan, so it has to be short."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judged(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and ruled (the rule's verdict)."""
    host, path = host_and_path(F.col(url_col))
    out = pages.withColumn("host", host).withColumn("path", path).withColumn("found", rule_of(F.col("host"), F.col("path")))
    return out.withColumn("rule", F.col("found.rule")).withColumn("ruled", F.col("found.verdict")).drop("found")


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts."""
    linked = pages.filter(F.contains(F.col(html_col), F.lit("//")))
    links = linked.select(host_and_path(F.col(url_col))[0].alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))).alias("dst"))
    return links.withColumn("dst", F.translate("dst", UPPER, LOWER)).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def _rounds(scores: DataFrame, step) -> DataFrame:
    """host and score after as many steps (from host, mass, score to the next score) as it takes until none moves by more than EPSILON."""
    while True:
        after = stored(step(scores).select("host", "mass", F.col("was"), "score"), "scores")
        most = after.agg(F.max(F.abs(F.col("score") - F.col("was")))).first()[0]
        drop_stored(scores)
        scores = after.select("host", "mass", "score")
        if (most or 0) <= EPSILON:
            return scores.select("host", "score")


def _shares(links: DataFrame) -> DataFrame:
    """src, dst and the share of the links of src that go to dst."""
    return stored(links.join(links.groupBy("src").agg(F.sum("n").alias("all")), "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share")), "shares")


def trust_of(shares: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, score: (1 - DAMPING) * mass + DAMPING * (what comes along the links + the host's part of what hosts without links have). seeds: host, mass of all hosts."""
    if shares.isEmpty():
        return seeds.select("host", F.col("mass").cast("double").alias("score"))
    all_mass = seeds.agg(F.sum("mass")).first()[0] or 1.0
    sources = stored(shares.select(F.col("src").alias("host")).distinct(), "sources")

    def step(scores: DataFrame) -> DataFrame:
        loose = scores.join(sources, "host", "left_anti").agg(F.sum("score")).first()[0] or 0.0
        came = shares.join(scores.select(F.col("host").alias("src"), "score"), "src").groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("share") * F.col("score")).alias("came"))
        new = F.col("mass") * (1 - DAMPING) + (F.coalesce("came", F.lit(0.0)) + F.col("mass") * (loose / all_mass)) * DAMPING
        return scores.withColumnRenamed("score", "was").join(came, "host", "left").withColumn("score", new)

    out = _rounds(stored(seeds.select("host", "mass", F.col("mass").cast("double").alias("score")), "scores"), step)
    drop_stored(sources)
    return out


def distrust_of(shares: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, score: mass + (1 - mass) * DAMPING * mean score of what the host links to, weighted by its links. seeds: host, mass of all hosts."""
    if shares.isEmpty():
        return seeds.select("host", F.col("mass").cast("double").alias("score"))

    def step(scores: DataFrame) -> DataFrame:
        ahead = shares.join(scores.select(F.col("host").alias("dst"), "score"), "dst").groupBy(F.col("src").alias("host")).agg(F.sum(F.col("share") * F.col("score")).alias("ahead"))
        new = F.col("mass") + (1 - F.col("mass")) * DAMPING * F.coalesce("ahead", F.lit(0.0))
        return scores.withColumnRenamed("score", "was").join(ahead, "host", "left").withColumn("score", new)

    return _rounds(stored(seeds.select("host", "mass", F.col("mass").cast("double").alias("score")), "scores"), step)


def host_verdicts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, trust, distrust and verdict, for every host of pages and links."""
    seen = judged(pages.select(url_col), url_col).filter("host <> ''").groupBy("host")
    seen = stored(seen.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")), "hosts")
    edges = stored(host_links(pages, url_col, html_col), "links")
    hosts = seen.select("host").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("host"))).distinct()
    seeds = stored(hosts.join(seen, "host", "left").select("host", *((F.coalesce(F.col(c) / F.col("pages"), F.lit(0.0))).alias(c) for c in ("good", "bad"))), "seeds")
    shares = _shares(edges)
    trust = trust_of(shares, seeds.select("host", F.col("good").alias("mass")))
    distrust = distrust_of(shares, seeds.select("host", F.col("bad").alias("mass")))
    drop_stored(shares, edges, seen)
    rounded = lambda c: F.round(F.col("score"), 9).alias(c)
    out = trust.select("host", rounded("trust")).join(distrust.select("host", rounded("distrust")), "host")
    return out.withColumn("verdict", F.when((F.col("distrust") >= THRESHOLD) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow"))


def verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict of each row."""
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    of_hosts = stored(host_verdicts(own).select("host", F.col("verdict").alias("by_host")), "verdicts")
    out = judged(own.select("page_id", "url")).join(of_hosts, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return verdicts(table(spark, sf_dir, "pages"))


#: Rounds of the SQL below, which has no way to stop by itself: what is missing then is under DAMPING ** SQL_ROUNDS, 3e-11, of the whole.
SQL_ROUNDS = 150


def _sql() -> str:
    """The same in SQL."""
    names = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    rest = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    link = PLAIN.replace("'", "''")
    return f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {names}) r(verdict, name, start)),
cut AS (SELECT page_id, html, {rest} AS rest FROM pages),
page AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
place AS (SELECT DISTINCT host, path FROM page),
fit AS (SELECT host, path, arg_max(name || start, length(name || start)) AS rule, arg_max(verdict, length(name || start)) AS ruled FROM place JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY host, path),
judged AS (SELECT page.*, rule, ruled FROM page LEFT JOIN fit USING (host, path)),
found AS (SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(html, '{link}', 1))), '{UPPER}', '{LOWER}') AS dst FROM page),
links AS (SELECT src, dst, count(*) AS n FROM found WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
hosts AS (SELECT host FROM page WHERE host <> '' UNION SELECT src FROM links UNION SELECT dst FROM links),
seeds AS (SELECT h.host, coalesce(count(*) FILTER (ruled = 'allow') / nullif(count(j.host), 0), 0) AS good, coalesce(count(*) FILTER (ruled = 'block') / nullif(count(j.host), 0), 0) AS bad FROM hosts h LEFT JOIN judged j ON j.host = h.host GROUP BY h.host),
share AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links),
sources AS (SELECT DISTINCT src FROM links),
trust AS (SELECT 0 AS i, host, good AS score FROM seeds UNION ALL
  SELECT n.i, s.host, s.good * {1 - DAMPING!r} + {DAMPING} * (coalesce(n.came, 0) + s.good * n.loose / (SELECT greatest(sum(good), 1e-300) FROM seeds))
  FROM seeds s JOIN (SELECT h.host, max(k.i) + 1 AS i, max(k.loose) AS loose, sum(e.share * r.score) AS came FROM seeds h
    CROSS JOIN (SELECT max(t.i) AS i, sum(CASE WHEN o.src IS NULL THEN t.score ELSE 0 END) AS loose FROM trust t LEFT JOIN sources o ON o.src = t.host) k
    LEFT JOIN share e ON e.dst = h.host LEFT JOIN trust r ON r.host = e.src GROUP BY h.host) n ON n.host = s.host WHERE n.i <= {SQL_ROUNDS}),
distrust AS (SELECT 0 AS i, host, bad AS score FROM seeds UNION ALL
  SELECT n.i, s.host, s.bad + (1 - s.bad) * {DAMPING} * coalesce(n.ahead, 0)
  FROM seeds s JOIN (SELECT h.host, max(k.i) + 1 AS i, sum(e.share * r.score) AS ahead FROM seeds h
    CROSS JOIN (SELECT max(i) AS i FROM distrust) k LEFT JOIN share e ON e.src = h.host LEFT JOIN distrust r ON r.host = e.dst GROUP BY h.host) n ON n.host = s.host WHERE n.i <= {SQL_ROUNDS}),
final AS (SELECT host, round(t.score, 9) AS trust, round(d.score, 9) AS distrust FROM (SELECT * FROM trust WHERE i = {SQL_ROUNDS}) t JOIN (SELECT * FROM distrust WHERE i = {SQL_ROUNDS}) d USING (host))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust >= {THRESHOLD} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN final USING (host)
"""


OP10_SQL = _sql()
