"""URL verdicts by rule, carried over to aliases along redirect and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.graph import components
from meterline.llm.scratch import Scratch

# Fixed values: (verdict, host, path). A rule fits its host and all subdomains.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sub-domains that serve the same pages, and parameters that only say where a visit came from.
# Such a name in front goes only where a name and a domain are left behind it.
SAME_SITE = r"^(?:www|m|mobile|amp)\.(?=[^.]+\.[^.])"
ORIGIN = r"^(?:ref|source|utm_[a-z]+|fbclid|gclid)="
TARGET = r"[?&](?:url|u|to|target|redirect|redirect_uri|next)=(https?(?::|%3[aA])[^&#]*)"
CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
BASE = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
AMPERSAND = r"(?i)&(?:amp|#0*38|#x0*26);"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    """From behind the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null without one. Rules are few: one expression."""
    rule = verdict = None
    for kind, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start) if rule is None else rule.when(fits, name + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def canonical(url: Column) -> Column:
    """One spelling for urls that differ in scheme, mobile host, fragment, index page or origin marks.

    Null where the url has no ://.
    """
    host = F.regexp_replace(host_of(url), SAME_SITE, "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/(?:index|default)\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(ORIGIN)))
    return F.when(host_of(url) != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def folded(path: Column) -> Column:
    """A path from / on without its . and .. segments."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"),
        lambda a, p: F.when(p == ".", a).when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
    )
    folder = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))


def resolved(raw: Column, base: Column) -> Column:
    """The url that ``raw`` names on a page at ``base``; null for schemes without ://."""
    site, path = F.concat(F.lit("http://"), host_of(base)), path_of(base)
    own, rest = F.regexp_extract(raw, r"(?s)^([^?#]*)", 1), F.regexp_extract(raw, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    out = F.when(raw.rlike(SCHEME + "//"), raw).when(raw.startswith("//"), F.concat(F.lit("http:"), raw)).when(raw.rlike(SCHEME), F.lit(None))
    out = out.when(raw.startswith("#"), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), raw))
    out = out.when(raw.startswith("?"), F.concat(site, F.when(path == "", "/").otherwise(path), raw))
    return out.otherwise(F.concat(site, folded(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))), rest))


def page_verdicts(pages: DataFrame, scratch: Scratch, *, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url, html).

    A page with a fitting rule gets that rule's verdict. Other urls form components
    over redirects: a page's url and its canonical spelling, the targets of its
    rel=canonical link, of its http-equiv refresh and of redirect parameters in the
    url. A page without a rule is blocked if its component has a blocked url and no
    allowed one: an explicit allow comes first, for the page and for its aliases.
    Link targets count with the rules' verdict on them, crawled or not. Relative
    targets are resolved against the page's url, or its base element; &amp; is decoded.

    Null urls, and urls without ://, have empty host and path, fit no rule, link to
    nothing and are allowed. Rows stay as they are, equal or not; equal urls are one
    node. A null html has no links. Further columns are ignored.
    """
    html = F.col("html").cast("string") if "html" in pages.columns else F.lit(None).cast("string")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("node", canonical(F.col("url"))).withColumn("rule", rule).withColumn("own", verdict)

    tag = lambda pattern: F.regexp_replace(F.regexp_extract("html", pattern, 1), AMPERSAND, "&")
    spoken = F.array(tag(CANONICAL), tag(REFRESH), F.try_url_decode(F.regexp_extract("url", TARGET, 1)))
    links = rows.where("node is not null").select("node", "url", tag(BASE).alias("base"), F.explode(F.filter(spoken, lambda x: x.isNotNull() & (x != ""))).alias("raw"))
    links = links.withColumn("base", F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolved(F.col("base"), F.col("url")), "url")))
    links = links.select("node", resolved(F.col("raw"), F.col("base")).alias("url")).where("url is not null")
    aim_rule, aim = matched(host_of(F.col("url")), path_of(F.col("url")), rules)
    links = scratch.table(links.select("node", canonical(F.col("url")).alias("to"), aim.alias("own")).where("`to` is not null").distinct())
    pages_seen = scratch.table(rows.where("node is not null").select("node", "own").distinct())

    edges = links.select(F.col("node").alias("a"), F.col("to").alias("b")).where("a <> b")
    labels = components(edges, scratch)
    said = pages_seen.unionByName(links.select(F.col("to").alias("node"), "own")).where("own is not null").distinct()
    said = said.join(labels, "node", "left").select(F.coalesce("component", "node").alias("c"), "own")
    blocked = said.groupBy("c").agg(F.max(F.col("own") == "block").alias("block"), F.max(F.col("own") == "allow").alias("allow")).where("block and not allow")
    bad = pages_seen.select("node").distinct().join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    bad = bad.join(blocked, "c", "left_semi").select("node", F.lit(True).alias("by_alias"))
    return rows.join(bad, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("by_alias"), "block"), F.lit("allow")).alias("verdict")
    )
