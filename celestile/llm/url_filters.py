"""URL filters with redirect equivalence (operator 1).

Urls that redirect to one another, or name one another as canonical, are aliases:
connected components over these links, found by distributed rounds. A rule on a url
decides that url. A url without a rule takes the decision of its aliases: allow if any
of them is allowed by a rule, else block if any is blocked, else allow.

Links are read from the pages (``rel=canonical`` and ``http-equiv=refresh``) and may be
given as a table of redirects. The nodes are ``host + path + query``: scheme and
fragment don't count. Columns and SQL functions only.

Nulls: a null url, or one without ``://``, has empty host and path, no rule, no aliases
and is allowed. Pages with one url share its decision. Links with a null end or
without a host are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from celestile.llm.graph import components
from celestile.llm.scratch import Scratch

#: (verdict, host, path)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Rules become one expression; larger sets go through ``judge_by_table``.
INLINE_RULES = 500


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """``host + path + query``; null without a host."""
    rest = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def judge(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``verdict``; null if none
    does. Of equal lengths allow comes first, then the longer host."""
    if len(rules) > INLINE_RULES:
        raise ValueError(f"{len(rules)} rules: use judge_by_table for more than {INLINE_RULES}")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", len(r[1]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """As ``judge`` for a table of rules ``(verdict, host, path)`` of any size: adds
    ``rule`` and ``verdict`` to the distinct ``urls (host, path)``. Each host meets the
    rules of its suffixes in an equi-join; the longest that fits is an aggregate that is
    combined before the exchange."""
    parts = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    spread = urls.select("host", "path").distinct().withColumn("of", F.explode(suffix))
    r = rules.select(F.col("host").alias("of"), F.col("path").alias("start"), "verdict")
    met = spread.join(r, "of").where(F.startswith(F.col("path"), F.col("start")))
    rank = F.struct((F.length("of") + F.length("start")).alias("n"), (F.col("verdict") == "allow").alias("ok"), F.length("of").alias("h"), F.concat("of", "start").alias("rule"), "verdict")
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").withColumns({"rule": F.col("best.rule"), "verdict": F.col("best.verdict")}).drop("best")


def _attribute(tag: Column, name: str) -> Column:
    got = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1)
    return F.trim(F.regexp_replace(F.regexp_replace(got, """^["']|["']$""", ""), "&amp;", "&"))


def canonical_of(html: Column) -> Column:
    tag = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    return F.nullif(_attribute(tag, "href"), F.lit(""))


def refresh_of(html: Column) -> Column:
    tag = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(_attribute(tag, "content"), r"(?is)\burl\s*=\s*(.*)$", 1), """^["']|["']$""", "")), F.lit(""))


def resolved(pages: DataFrame, targets: list[str]) -> DataFrame:
    """``pages (url, path, ...)`` with each column of link targets made an absolute url; dot
    segments stay as they are. Its parts are columns, so each is computed once."""
    base, site, folder = F.substring_index("url", "://", 1), F.col("_site"), F.col("_folder")
    out = pages.withColumn("_site", F.concat(base, F.lit("://"), F.regexp_extract(_rest(F.col("url")), r"^[^/?#]*", 0)))
    out = out.withColumn("_folder", F.regexp_replace("path", r"[^/]*$", ""))
    for name in targets:
        t = F.col(name)
        out = out.withColumn(
            name,
            F.when(F.rlike(t, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), t)
            .when(F.startswith(t, F.lit("//")), F.concat(base, F.lit(":"), t))
            .when(F.startswith(t, F.lit("/")), F.concat(site, t))
            .when(F.startswith(t, F.lit("?")), F.concat(site, F.col("path"), t))
            .when(F.startswith(t, F.lit("#")), F.col("url"))
            .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), t)),
        )
    return out.drop("_site", "_folder")


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, root)`` of every page. ``redirects`` is
    ``(src, dst)`` of urls; ``root`` names the alias class, null for a url without aliases."""
    scratch = Scratch(pages.sparkSession, "urls")
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    seen = pages.select("page_id", url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), canonical_of(html).alias("canonical"), refresh_of(html).alias("refresh"))
    seen = resolved(seen, ["canonical", "refresh"]).withColumns({n: node_of(F.col(n)) for n in ("canonical", "refresh")})
    seen = scratch.save(seen.withColumn("own", judge(F.col("host"), F.col("path"), rules)).drop("url"), "seen")
    links = seen.select(F.col("node").alias("src"), F.explode(F.array("canonical", "refresh")).alias("dst"))
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")))
    classes = scratch.save(components(links, scratch), "classes")
    named = classes.withColumns({"host": F.regexp_extract("node", r"^[^/?]*", 0), "path": F.regexp_extract("node", r"^[^/?]*([^?]*)", 1)})
    judged = named.withColumn("own", judge(F.col("host"), F.col("path"), rules)["verdict"])
    verdicts = judged.groupBy("root").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    verdicts = scratch.save(verdicts, "verdicts")
    aliases = classes.join(verdicts, "root").select("node", "root", F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow").alias("shared"))
    aliases = scratch.save(aliases, "aliases")
    out = seen.join(aliases, "node", "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "shared", F.lit("allow")).alias("verdict"), "root")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


_HREF = r"""(?is)\b{}\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)"""


def _sql() -> str:
    """The same in SQL, components by recursion (for pages without long chains of aliases)."""
    rest = "CASE WHEN instr({u}, '://') > 0 THEN substr({u}, instr({u}, '://') + 3) ELSE '' END"
    lower = f"translate({{x}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    host = lambda u: lower.format(x=f"regexp_extract(coalesce({rest.format(u=u)}, ''), '^[^/?#]*', 0)")
    path = lambda u: f"regexp_extract(coalesce({rest.format(u=u)}, ''), '^[^/?#]*([^?#]*)', 1)"
    node = lambda u: f"CASE WHEN {host(u)} <> '' THEN {host(u)} || regexp_extract({rest.format(u=u)}, '^[^/?#]*([^#]*)', 1) END"
    attribute = lambda tag, name: f"trim(replace(regexp_replace(regexp_extract({tag}, '{_HREF.format(name)}', 1), '^[\"'']|[\"'']$', '', 'g'), '&amp;', '&'))"
    link = attribute("regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*[\"'']?canonical\\b[^>]*>', 0)", "href")
    meta = attribute("regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*[\"'']?refresh\\b[^>]*>', 0)", "content")
    meta = f"trim(regexp_replace(regexp_extract({meta}, '(?is)\\burl\\s*=\\s*(.*)$', 1), '^[\"'']|[\"'']$', '', 'g'))"
    site = "split_part(url, '://', 1) || '://' || regexp_extract(" + rest.format(u="url") + ", '^[^/?#]*', 0)"
    folder = f"regexp_replace({path('url')}, '[^/]*$', '')"
    full = f"""CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
        WHEN target LIKE '//%' THEN split_part(url, '://', 1) || ':' || target
        WHEN target LIKE '/%' THEN {site} || target
        WHEN target LIKE '?%' THEN {site} || {path('url')} || target
        WHEN target LIKE '#%' THEN url
        ELSE {site} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || target END"""
    best = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", -len(r[1])))
    fits = [(v, h, p, f"((host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}'))") for v, h, p in best]
    case = lambda i: "CASE " + " ".join(f"WHEN {f} THEN '{(h + p, v)[i]}'" for v, h, p, f in fits) + " END"
    return f"""
WITH RECURSIVE seen AS (SELECT *, {node('url')} AS node FROM (SELECT page_id, url, html, {host('url')} AS host, {path('url')} AS path FROM pages)),
targets AS (SELECT node, url, nullif({link}, '') AS target FROM seen UNION ALL SELECT node, url, nullif({meta}, '') FROM seen),
links AS (SELECT node AS a, {node('full_url')} AS b FROM (SELECT node, {full} AS full_url FROM targets WHERE target IS NOT NULL)),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
roots AS (SELECT a AS node, least(min(b), a) AS root FROM reach GROUP BY a),
judged AS (SELECT root, node, {case(1)} AS own FROM (SELECT *, {host("('x://' || node)")} AS host, {path("('x://' || node)")} AS path FROM roots)),
shared AS (SELECT root, CASE WHEN bool_or(own = 'allow') THEN 'allow' WHEN bool_or(own = 'block') THEN 'block' ELSE 'allow' END AS verdict FROM judged GROUP BY root)
SELECT page_id, host, path, {case(0)} AS rule, coalesce({case(1)}, shared.verdict, 'allow') AS verdict, roots.root
FROM seen LEFT JOIN roots USING (node) LEFT JOIN shared ON roots.root = shared.root
"""


SQL = _sql()
