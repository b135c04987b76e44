"""URL filters with redirect equivalence.

Rules name a host and a path; the longest one that fits decides.  Urls that
redirect to each other or name each other as canonical are one page: a block of
any of them holds for all that no rule allows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.components import components
from dugout.llm.runtime import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does; of equally long ones an allow goes first.

    The rules are an argument's list, some hundreds at most: they become one expression.
    """
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    nothing = F.lit(None).cast("struct<rule:string,verdict:string>")

    def add(rest: Column, rule: Rule) -> Column:
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        return F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(rest)

    return reduce(add, reversed(ordered), nothing)


def url_key(url: Column) -> Column:
    """The url without fragment, scheme and host lowered: what tells pages apart."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(bare, r"(?s)^.*?://[^/?]*(.*)$", 1)
    return F.when(bare.contains("://"), F.concat(scheme, F.lit("://"), host_of(bare), rest)).otherwise(bare)


def _absolute(target: Column, base: Column) -> Column:
    """A link's target, resolved against the page's url."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target == "", F.lit(None).cast("string"))
        .otherwise(F.concat(folder, target))
    )


def aliases(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): keys of a page's url and of the canonical link or meta redirect in its html."""
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    opened = pages.filter(F.col(url).isNotNull()).select(F.col(url).alias("base"), F.explode(tags).alias("tag"))
    canonical = F.when(F.col("tag").rlike(r"""(?i)^<link\b[^>]*\brel\s*=\s*["']?canonical\b"""), F.regexp_extract("tag", r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)""", 1))
    redirect = F.when(
        F.col("tag").rlike(r"""(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("tag", r"""(?i)\burl\s*=\s*["']?\s*([^"'\s>]+)""", 1)
    )
    targets = opened.select("base", F.coalesce(canonical, redirect).alias("target")).filter("target != ''")
    resolved = targets.select("base", _absolute(F.regexp_replace("target", "&amp;", "&"), F.col("base")).alias("target"))
    return resolved.select(url_key(F.col("base")).alias("u"), url_key(F.col("target")).alias("v")).filter("u != v").distinct()


def judged(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    ``redirects`` adds known pairs (u, v) of urls to those that the pages' html
    names.  A page that a rule fits has that rule's verdict.  Another one is
    blocked if a url joined to its own by redirects or canonical links, over any
    number of them, is blocked by a rule; else it is allowed.  A null url, or one without ``://``, has
    an empty host and path, fits no rule and is allowed.  Repeated rows are judged
    alike; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    links = aliases(pages)
    if redirects is not None:
        left, right = redirects.columns[:2]
        links = links.unionAll(redirects.select(url_key(F.col(left)), url_key(F.col(right))))
    reached = components(links, scratch)
    by_rule = reached.select("component", fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules).alias("found"))
    blocked = by_rule.filter("found.verdict = 'block'").select("component").distinct()
    stained = reached.join(blocked, "component").select("node", F.lit(True).alias("stained"))
    hosted = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = hosted.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules))
    joined = found.join(stained, url_key(F.col("url")) == F.col("node"), "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("stained"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
