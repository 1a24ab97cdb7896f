"""URL rules with redirect equivalence.

Rules on (host, path prefix) decide first: the longest fitting rule wins. Pages
without a rule take the verdict of their alias class: URLs joined by canonical
links, refresh redirects and an optional redirect table form connected
components, and an explicit allow in the class outranks an explicit block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinity.llm.components import components
from affinity.session import stage

#: (verdict, host, path prefix)
Rule = tuple[str, str, str]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """One name for the spellings of a URL that differ in scheme, host case or fragment only; null without ``://``."""
    query = F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.concat(F.lit("x://"), host_of(url), path_of(url), query))


def rule_column(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits, null where none does (ties: the earlier rule)."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))) if out is None else out.when(fits, F.lit(value(rule)))
    return out if out is not None else F.lit(None).cast("string")


def _resolve(target: Column, url: Column) -> Column:
    """An absolute URL for a link target found on the page ``url``."""
    origin = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (F.when(F.instr(target, "://") > 0, target)
            .when(target.startswith("//"), F.concat(F.lit("x:"), target))
            .when(target.startswith("/"), F.concat(origin, target))
            .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target)))


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) nodes of canonical links and refresh redirects found in the pages' markup."""
    url, html = F.col("_url"), F.col("_html")
    found = F.array(F.regexp_extract(F.regexp_extract(html, _CANONICAL, 0), _HREF, 1),
                    F.regexp_extract(F.regexp_extract(html, _REFRESH, 0), _TARGET, 1))
    return (pages.select(F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
            .filter(F.instr(url, "://") > 0)
            .filter(html.rlike(r"(?i)canonical|http-equiv"))
            .select(url, F.explode(found).alias("_target")).filter(F.col("_target") != "")
            .select(node_of(url).alias("src"), node_of(_resolve(F.col("_target"), url)).alias("dst"))
            .filter(F.col("src") != F.col("dst")).distinct())


def judge_urls(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, host, path, rule (``host+path`` of the winning rule or null), verdict.

    ``redirects`` (src, dst URLs) adds alias edges beyond those in the markup.
    Null URLs and URLs without ``://`` have empty host and path, fit no rule and
    get ``default``. A page with a rule keeps the rule's verdict whatever its
    aliases say. Repeated pages repeat their row; an empty table gives none.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst"))
                                  .filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst"))
    edges = stage(edges, "url_edges")
    url = F.col("_url")
    judged = (pages.select(F.col(id_col), url_col if url_col == "_url" else F.col(url_col).alias("_url"))
              .select(id_col, host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("_node")))
    host, path = F.col("host"), F.col("path")
    judged = judged.withColumns({"rule": rule_column(host, path, rules, lambda r: r[1] + r[2]),
                                 "_own": rule_column(host, path, rules, lambda r: r[0])})
    if edges.isEmpty():
        classes = None
    else:
        member = components(edges, "src", "dst")
        node = F.col("node")
        own = rule_column(host_of(node), path_of(node), rules, lambda r: r[0])
        votes = (member.withColumn("_vote", own).groupBy("component")
                 .agg(F.bool_or(F.col("_vote") == "allow").alias("_allow"), F.bool_or(F.col("_vote") == "block").alias("_block")))
        verdict = F.when(F.col("_allow"), F.lit("allow")).when(F.col("_block"), F.lit("block"))
        classes = member.join(votes, "component").select(node.alias("_node"), verdict.alias("_class"))
    judged = judged.withColumn("_class", F.lit(None).cast("string")) if classes is None else judged.join(classes, "_node", "left")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("_own", "_class", F.lit(default)).alias("verdict"))
