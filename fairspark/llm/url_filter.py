"""Operator 4, URL filters with redirect equivalence: URLs that redirect or declare a canonical form share one component, through which blocks spread to aliases."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, cut, table
from .components import connected_components


class Rule(NamedTuple):
    action: str
    host: str
    path: str


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    return F.when(F.instr(url, F.lit("://")) > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, F.lit("://")) + 3, F.length(url))
    return F.when(F.instr(url, F.lit("://")) > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, allow before block at equal length; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.action == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action"))).otherwise(out)
    return out


def node_of(url: Column) -> Column:
    """What identifies a URL as an alias: lower-cased host, path and query, without scheme and fragment; null without a host."""
    tail = F.regexp_extract(url, r"://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail))))


def undotted(path: Column) -> Column:
    """A path that begins with a slash, without its segments . and .. (which take the segment before them away)."""
    parts = F.split(F.substring(path, 2, F.length(path)), "/", -1)

    def add(out, i, part):
        dots, last = part.isin(".", ".."), i == F.size(parts) - 1
        held = F.when(part == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(out)
        return F.concat(held, F.when(dots & last, F.array(F.lit(""))).when(dots, F.array().cast("array<string>")).otherwise(F.array(part)))

    numbered = F.transform(parts, lambda x, i: F.struct(i.alias("i"), x.alias("part")))
    kept = F.aggregate(numbered, F.array().cast("array<string>"), lambda out, x: add(out, x["i"], x["part"]))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(url: Column, to: Column) -> Column:
    """The URL that a reference on the page url means; null for schemes without ://, as in mailto:."""
    own, path, rest = path_of(url), F.regexp_extract(to, r"^[^?#]*", 0), F.regexp_extract(to, r"^[^?#]*([\s\S]*)", 1)
    folder = F.regexp_extract(own, r"^/(?:[\s\S]*/)?", 0)
    full = F.when(path == "", F.when(own == "", F.lit("/")).otherwise(own)).when(path.startswith("/"), undotted(path))
    full = full.otherwise(undotted(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)))
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:"
    out = F.when(to.rlike(scheme + "//"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.rlike(scheme) | to.startswith("#"), F.lit(None).cast("string"))
    return out.otherwise(F.concat(F.lit("http://"), host_of(url), full, rest))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): from each page's node to that of its canonical link and of its meta refresh. Relative targets are resolved against
    the page's own URL (a base tag is not read); of entities only that of & is decoded. OP4_SQL knows neither."""
    tag = {"canonical": r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", "refresh": r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""}
    where = {"canonical": r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", "refresh": r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""}
    targets = F.array(*[F.when(F.col("html").rlike(tag[k]), F.regexp_extract(F.regexp_extract("html", tag[k], 0), where[k], 1)) for k in tag])
    found = pages.select("url", F.explode(F.filter(targets, lambda x: x.isNotNull() & (x != ""))).alias("to"))
    to = F.regexp_replace("to", "&(?:amp|#0*38|#[xX]0*26);", "&")
    return found.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), to)).alias("b"))


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule, verdict.

    The verdict is that of the longest rule that fits the URL. Where none fits, it is that of the page's component over
    canonical links, meta refreshes and redirects (a DataFrame from_url, to_url): allow if any URL of the component has an
    allow rule of its own, else block if any has a block rule, else allow. A null URL or one without :// has an empty host
    and path, fits no rule that names a host and joins no component. Null html has no links. Repeated rows return each; an
    empty table returns none; other columns are neither read nor returned. rules is a list in the program, of some hundreds
    at most.
    """
    url = F.col("url")
    edges = link_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")))
    edges = cut(edges.where("a <> b").distinct())
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.action", F.lit("allow")).alias("verdict"))
    members = cut(connected_components(edges))
    as_url = F.concat(F.lit("http://"), F.col("node"))
    acted = members.withColumn("own", rule_of(host_of(as_url), path_of(as_url), rules))
    whole = acted.groupBy("component").agg(F.max((F.col("own.action") == "allow").cast("int")).alias("allows"), F.max((F.col("own.action") == "block").cast("int")).alias("blocks"))
    blocked = members.join(whole.where("blocks = 1 and coalesce(allows, 0) = 0").select("component"), "component", "left_semi").select("node", F.lit("block").alias("spread"))
    return rows.join(blocked, "node", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.action", "spread", F.lit("allow")).alias("verdict"))


def op4_redirect_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _sql_rule(host: str, path: str) -> str:
    order = sorted(RULES, key=lambda r: (len(r.host + r.path), r.action == "allow"), reverse=True)
    fits = lambda r: f"(({host}) = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}')"
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.action} {r.host}{r.path}'" for r in order) + " END"


_FROM, _TO = f"'{UPPER}'", f"'{LOWER}'"
OP4_SQL = f"""
WITH RECURSIVE u AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '://([^/?#]*)', 1), {_FROM}, {_TO}) ELSE '' END AS host,
       CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
       CASE WHEN contains(url, '://') THEN regexp_extract(url, '://[^/?#]*([^#]*)', 1) END AS tail FROM pages),
p AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END END AS node, {_sql_rule('host', 'path')} AS own FROM u),
l AS (SELECT host, node AS a, unnest([regexp_extract(regexp_extract(html, '(?i)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1),
       regexp_extract(regexp_extract(html, '(?i)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'), '(?i)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)]) AS t FROM p),
f AS (SELECT a, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t WHEN starts_with(t, '/') THEN 'http://' || host || t END AS t FROM l WHERE t <> ''),
e AS (SELECT a, translate(regexp_extract(t, '://([^/?#]*)', 1), {_FROM}, {_TO}) || CASE WHEN starts_with(regexp_extract(t, '://[^/?#]*([^#]*)', 1), '/') THEN '' ELSE '/' END || regexp_extract(t, '://[^/?#]*([^#]*)', 1) AS b FROM f),
sym AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM sym UNION SELECT r.a, x.b FROM reach r JOIN sym x ON r.b = x.a),
rule AS (SELECT a, {_sql_rule("regexp_extract(b, '^[^/?#]*')", "regexp_extract(b, '^[^/?#]*([^?#]*)', 1)")} AS own FROM reach),
spread AS (SELECT a AS node, CASE WHEN bool_or(coalesce(own LIKE 'allow%', false)) THEN 'allow' WHEN bool_or(coalesce(own LIKE 'block%', false)) THEN 'block' END AS verdict FROM rule GROUP BY a)
SELECT page_id, host, path, substr(own, 7) AS rule, coalesce(substr(own, 1, 5), verdict, 'allow') AS verdict FROM p LEFT JOIN spread USING (node)
"""
