"""URL filters: explicit rules, and a path-template tree per host.

Rules name a host and a path prefix; a rule fits its host and all subdomains
when the path starts with its path, and the longest rule wins.  Urls without a
rule are judged by templates learned from labelled urls:

1. Runs of digits become ``#`` and equal (host, path) are counted together, so
   the tree's input has one row for each shape of a host's paths.
2. Level by level from the host down, segments are generalised: a parent with
   more than ``BRANCHES`` children has its children of little support turned
   into ``*``, unless their share of bad labels differs even when so many
   siblings are tried: ``l * KL(bad / l, share of the parent)``, the exponent of
   Hoeffding's bound on the exact test's tail, above ``ln(2 * branches / ALPHA)``.
   Branches whose share does not differ from that of their siblings
   (two-proportion z below ``Z``) are merged into ``*`` too.  What stays literal
   is different, and frequent or surely so.
3. A template is rejected when the smoothed share of good labels among its urls,
   ``(good + PRIOR * base) / (labelled + PRIOR)``, is below ``PURITY``; base is
   the share over all hosts.

Counts cover all rows and are summed before every shuffle; a hot host is a few
shapes, not a group of rows.  Only rejected shapes are joined back to the urls.

The tables hold no labels of urls, so the query labels each page by its own text:
bad where the quality rules, fitted on the labelled documents, would reject it.
Such a label speaks of the page, and of its host or path only as far as they go
together; a template is rejected on the labels of all its pages, never on one.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule and verdict allow.  Paths deeper than ``DEPTH`` segments keep the rest as
one segment.  Unlabelled templates take the base share.  Repeated rows count as
often as they occur; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Workspace

#: The production rules, as (host, path, action).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

DEPTH = 6
BRANCHES = 16
SUPPORT = 0.1
Z = 1.96
ALPHA = 0.05
PRIOR = 5.0
PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its action; nulls if none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, a in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(a)).otherwise(action)
    return rule, action


def shape(path: Column) -> Column:
    return F.regexp_replace(path, "[0-9]+", "#")


def _segments(column: Column) -> Column:
    """DEPTH segments; the last one holds what is deeper; nulls beyond the path's end."""
    return F.split(F.regexp_replace(column, "^/", ""), "/", DEPTH)


def template_tree(shapes: DataFrame, ws: Workspace) -> DataFrame:
    """shapes: (host, shape, n, labelled, bad), one row each -> the same with ``template``, a list of segments."""
    now = ws.save(shapes.withColumns({"seg": _segments(F.col("shape")), "template": F.array().cast("array<string>")}), "level0")
    for d in range(DEPTH):
        part = F.get("seg", F.lit(d))
        live = now.withColumn("part", part)
        children = live.where("part is not null").groupBy("host", "template", "part").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        parents = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("branches"), F.sum("n").alias("all"), F.sum("l").alias("all_l"), F.sum("b").alias("all_b"))
        both = children.join(parents, ["host", "template"])
        rest = F.col("all_l") - F.col("l")
        p = F.col("all_b") / F.greatest(F.col("all_l"), F.lit(1))
        se = F.sqrt(p * (1 - p) * (1 / F.greatest(F.col("l"), F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
        gap = F.abs(F.col("b") / F.greatest(F.col("l"), F.lit(1)) - (F.col("all_b") - F.col("b")) / F.greatest(rest, F.lit(1)))
        similar = (F.col("l") == 0) | (rest == 0) | (se == 0) | (gap < Z * se)
        rare = (F.col("branches") > BRANCHES) & (F.col("n") < SUPPORT * F.col("all"))
        share = F.col("b") / F.greatest(F.col("l"), F.lit(1))
        kl = F.when(share > 0, share * F.log(share / p)).otherwise(0.0) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0)
        sure = F.col("l") * kl > F.log(2 * F.col("branches") / F.lit(ALPHA))
        named = both.select("host", "template", "part", F.when(similar | (rare & ~sure), "*").otherwise(F.col("part")).alias("name"))
        grown = live.join(named, ["host", "template", "part"], "left").select("host", "shape", "n", "labelled", "bad", "seg", F.when(F.col("part").isNull(), F.col("template")).otherwise(F.array_append("template", F.coalesce("name", "part"))).alias("template"))
        nxt = ws.save(grown, f"level{d + 1}")
        ws.drop(f"level{d}")
        now = nxt
        if now.where(F.size("seg") > d + 1).isEmpty():
            break
    return now.drop("seg")


def rejected_templates(tree: DataFrame) -> DataFrame:
    """(host, template, purity) of the templates whose smoothed purity is too low."""
    labelled, bad = tree.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    base = 1 - bad / labelled if labelled else 1.0
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("labelled") - F.col("bad") + F.lit(PRIOR * base)) / (F.col("labelled") + F.lit(PRIOR))
    return leaves.select("host", "template", purity.alias("purity")).where(F.col("purity") < PURITY)


def filter_urls(urls: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, bad) -> (page_id, host, path, rule, verdict); ``bad`` is true, false, or null where unlabelled."""
    ws = Workspace(urls.sparkSession, "urls")
    plain = urls.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("bad").cast("boolean").alias("bad"))
    host, path = host_and_path(F.col("url"))
    pages = plain.select("page_id", "bad", host.alias("host"), path.alias("path"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    shapes = pages.where("host != ''").groupBy("host", shape(F.col("path")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), one(F.col("bad").isNotNull()).alias("labelled"), one(F.col("bad")).alias("bad"))
    tree = template_tree(shapes, ws)
    blocked = tree.join(rejected_templates(tree), ["host", "template"], "left_semi").select("host", "shape", F.lit(True).alias("blocked"))
    blocked = ws.save(blocked, "blocked")
    judged = pages.withColumn("shape", shape(F.col("path"))).join(blocked, ["host", "shape"], "left")
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


#: Elements whose content is no text of the page, and those that end a line.
SILENT, LINE = "script|style|nav|head|noscript|template", "p|div|li|ul|ol|tr|table|section|article|header|footer|blockquote|h[1-6]"


def page_text(html: Column) -> Column:
    """The running text of a page: without silent elements, comments and tags, lines where blocks end; null for a null page."""
    spoken = F.regexp_replace(html, rf"(?is)<({SILENT})\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(spoken, rf"(?i)</({LINE})\s*>|<br\b[^>]*>", "\n")
    return F.regexp_replace(lines, "<[^>]*>", " ")
