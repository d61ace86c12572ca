"""Operator 6: URL filters with redirect equivalence.

Rules of the form host and path judge URLs. Redirect and canonical-link edges join URLs that are
aliases; distributed connected components then carry a decision to the aliases that no rule judges.
Within a component an explicit allow goes before any block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import written

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the URL's path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """A struct of rule and verdict of the longest rule that fits, or null; of equally long ones an allow wins."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.verdict == ALLOW, r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def resolved(target: Column, base: Column) -> Column:
    """A link's target as an absolute URL, where the base allows that; else null."""
    target = F.trim(target)
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*/(?:[^?#]*/)?)", 1)
    folder = F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder)
    known = F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
    known = known.when(target.startswith("/"), F.concat(origin, target)).when(~target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & (target != ""), F.concat(folder, target))
    return F.when(origin != "", known).when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)


def resource(url: Column) -> Column:
    """A URL without its fragment: what redirects and canonical links name."""
    return F.regexp_extract(url, r"(?s)^([^#]*)", 1)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) of canonical links and of redirects by meta refresh, over whole pages."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.col(url_col)
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b(?=[^>]*(?:canonical|refresh))[^>]*>)"), F.lit(1))
    tag = pages.where(url.isNotNull()).select(url.alias("source"), F.explode(tags).alias("tag"))
    href = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract("tag", r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?;\s*url\s*=\s*["']?([^"'\s>]+)""", 1)
    canonical = F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b""")
    moved = F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b""")
    target = F.when(canonical, href).when(moved, refresh)
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    return tag.select("source", resolved(target, F.col("source")).alias("target")).where("target is not null")


def judge(urls: DataFrame, links: DataFrame, rules: list[Rule], url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """``urls`` in a struct ``row`` with host, path, rule and verdict.

    The verdict is the longest fitting rule's; without one, an allow if any alias (a URL that
    ``links`` join to it over any number of steps) has an allowing rule, else a block if any has a
    blocking one, else ``default``. A null URL has an empty host and path and no alias. Repeated rows
    are judged each; columns of any name are kept apart in ``row``; URLs of any length are judged
    whole; an empty table gives no rows, and without links only the rules and the default decide.
    Of aliases that differ in verdict an allow wins; of rules equally long an allow too.
    """
    edges = links.select(resource(F.col("source")).alias("from"), resource(F.col("target")).alias("to")).where("`from` <> `to`").distinct()
    edges = written(edges, "links")
    own = urls.select(F.struct(*(F.col(f"`{c}`") for c in urls.columns)).alias("row"), F.col(f"`{url_col}`").cast("string").alias("url"))
    own = own.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    own = own.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        verdict = F.coalesce("own.verdict", F.lit(default))
        return own.select("row", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
    # Components are of digests of URLs: 128 bits, so that unrelated components don't merge by chance.
    number = lambda c: F.md5(F.col(c).cast("binary"))
    roots = connected_components(edges.select(number("from").alias("a"), number("to").alias("b")))
    nodes = edges.select(F.col("from").alias("u")).union(edges.select(F.col("to").alias("u"))).distinct()
    nodes = nodes.withColumn("verdict", longest_rule(host(F.col("u")), path(F.col("u")), rules).getField("verdict"))
    nodes = nodes.join(roots, number("u") == F.col("node")).select("u", "root", "verdict")
    allows, blocks = (F.max(F.coalesce(F.col("verdict") == v, F.lit(False))) for v in (ALLOW, BLOCK))
    classes = nodes.groupBy("root").agg(allows.alias("allows"), blocks.alias("blocks")).where("allows or blocks")
    passed = nodes.join(classes, "root").select("u", F.when(F.col("allows"), ALLOW).otherwise(BLOCK).alias("passed"))
    # Rows with a rule of their own stay out of the join.
    ruled = own.where("own is not null").select("row", "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("verdict"))
    rest = own.where("own is null").withColumn("u", resource(F.col("url")))
    named = rest.where("u is not null").join(passed, "u", "left").select("row", "host", "path", "passed")
    named = named.unionByName(rest.where("u is null").select("row", "host", "path", F.lit(None).cast("string").alias("passed")))
    return ruled.unionByName(named.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.coalesce("passed", F.lit(default)).alias("verdict")))


def oracle(rules: list[Rule]) -> str:
    """SQL for pages, their canonical links and meta refreshes given as absolute URLs."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != ALLOW, r.text))

    def case(column: str, h: str = "host", p: str = "path") -> str:
        return "CASE " + " ".join(f"WHEN ({h} = '{r.host}' OR ends_with({h}, '.{r.host}')) AND starts_with({p}, '{r.path}') THEN '{getattr(r, column)}'" for r in ordered) + " END"

    parts = "regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1)", "regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    h, p = lower.format(parts[0]), parts[1]
    return f"""
WITH RECURSIVE own AS (
  SELECT page_id, url, host, path, {case("text")} AS rule, {case("verdict")} AS verdict
  FROM (SELECT page_id, url, {h.format(u="url")} AS host, {p.format(u="url")} AS path FROM pages)
), tags AS (
  SELECT url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL
), targets AS (
  SELECT url, CASE
    WHEN regexp_matches(tag, '(?is)^<link\\b.*\\brel\\s*=\\s*["'']?canonical\\b') THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta\\b.*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?is);\\s*url\\s*=\\s*["'']?([^"''\\s>]+)', 1)
  END AS target FROM tags
), links AS (
  SELECT DISTINCT split_part(url, '#', 1) AS a, split_part(replace(target, '&amp;', '&'), '#', 1) AS b FROM targets WHERE target LIKE '%://%'
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
node AS (SELECT u, {case("verdict", h.format(u="u"), p.format(u="u"))} AS verdict FROM (SELECT DISTINCT a AS u FROM both_ways)),
passed AS (
  SELECT r.a AS u, CASE WHEN bool_or(n.verdict = 'allow') THEN 'allow' WHEN bool_or(n.verdict = 'block') THEN 'block' END AS verdict
  FROM reach r JOIN node n ON n.u = r.b GROUP BY r.a
)
SELECT o.page_id, o.host, o.path, o.rule, coalesce(o.verdict, p.verdict, 'allow') AS verdict
FROM own o LEFT JOIN passed p ON p.u = split_part(o.url, '#', 1)
"""
