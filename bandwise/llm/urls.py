"""URL filters that also reach aliases: block decisions spread over redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandwise.llm.common import ascii_lower, cut
from bandwise.llm.components import connected_components


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path of a url starts with `path`."""

    verdict: str  # allow or block
    host: str
    path: str = "/"


def host_of(url: Column) -> Column:
    """Behind the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; none, or null: empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """Behind the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """(length, allow, rule, verdict) of the longest rule that fits, or null; allow wins among equally long ones."""
    options = []
    for rule in rules:
        name = rule.host + rule.path
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.struct(
            F.lit(len(name)).alias("length"),
            F.lit(rule.verdict == "allow").alias("allow"),
            F.lit(name).alias("rule"),
            F.lit(rule.verdict).alias("verdict"),
        )
        options.append(F.when(fits, found))
    if not options:
        return F.lit(None).cast("struct<length:int,allow:boolean,rule:string,verdict:string>")
    return F.array_max(F.array(*options))


def plain_url(url: Column) -> Column:
    """The address a server redirects to: no fragment, and no query if it only says where a visitor comes from."""
    return F.regexp_replace(url, r"(?s)(\?utm_source=[^&#]*)?(#.*)?\z", "")


def _without_dots(path: Column) -> Column:
    """A path without `.` and `..`, which take the part before them along but never the root."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), closed)


def absolute_link(url: Column, link: Column) -> Column:
    """Where a link on the page `url` leads to; null without a link.

    `&amp;` is decoded. Links with a scheme stay as they are; `//host` takes the page's scheme, `/path` its host, `?query`
    its path, `#fragment` its query, and other links are relative to the folder of its path. Links on pages without `://`
    stay as they are.
    """
    link = F.nullif(F.regexp_replace(link, r"(?i)&(amp|#38|#x26);", "&"), F.lit(""))
    scheme = F.regexp_extract(url, r"(?s)\A(.*?:)//", 1)
    root = F.regexp_extract(url, r"(?s)\A(.*?://[^/?#]*)", 1)
    path = path_of(url)
    before_fragment = F.regexp_replace(url, r"(?s)#.*\z", "")
    folder = F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)\A(.*/)", 1), F.lit("")), F.lit("/"))
    own = F.regexp_extract(link, r"(?s)\A([^?#]*)", 1)
    rest = F.regexp_extract(link, r"(?s)\A[^?#]*(.*)\z", 1)
    whole = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))
    return (
        F.when(root == "", link)
        .when(link.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("#")), F.concat(before_fragment, link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path, link))
        .otherwise(F.concat(root, _without_dots(whole), rest))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges `_from`, `_to` from a page's url to its canonical link, its refresh target, and its plain form."""
    canonical = F.regexp_extract(html, r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(
        html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)""", 1
    )
    links = [absolute_link(F.col(url), link) for link in (canonical, refresh)]
    found = F.array(*links, plain_url(F.col(url)))
    # The explode must not keep the pages' html.
    edges = pages.select(F.col(url).alias("_from"), F.explode(F.array_compact(found)).alias("_to"))
    return edges.filter("_from <> _to")


def judge_urls(pages: DataFrame, rules: list[Rule], edges: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with `_host`, `_path`, `_rule` and `_verdict`.

    The longest rule that fits a url decides on it. Urls without a rule take over from their class, the urls connected
    by edges whatever their direction: an explicit allow within the class wins, else a block; without either the verdict
    is allow. Targets of edges need not be pages; rules are applied to them as well.

    Null urls and urls without `://` have an empty host and path, fit no rule, and are allowed unless an alias is
    blocked; null urls have no alias. Repeated urls are judged alike and all come back; no pages give no rows. Columns
    of `pages` keep their names, whatever they are, but for those beginning with an underscore.

    Classes are found for urls with an edge only; other urls are judged row by row. A class of any size is one sum.
    """
    link = edges.select("_from", "_to")
    classes = cut(connected_components(link, "_from", "_to"))
    rule = fitting_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    ruled = classes.select("component", rule.alias("_own")).filter("_own is not null")
    by_class = cut(ruled.groupBy("component").agg(F.bool_or("_own.allow").alias("_allowed")))
    spread = classes.join(by_class, "component").select(F.col("node").alias("_node"), "_allowed")
    spread = cut(spread)
    own = {"_host": host_of(F.col(url)), "_path": path_of(F.col(url))}
    judged = pages.withColumns(own).withColumn("_own", fitting_rule(F.col("_host"), F.col("_path"), rules))
    judged = judged.join(spread, F.col(url) == F.col("_node"), "left")
    passed_on = F.when(F.col("_allowed"), "allow").when(~F.col("_allowed"), "block").otherwise("allow")
    return judged.withColumns(
        {"_rule": F.col("_own.rule"), "_verdict": F.coalesce(F.col("_own.verdict"), passed_on)}
    ).drop("_own", "_node", "_allowed")
