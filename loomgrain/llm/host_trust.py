"""Operator 9: URL filters with link-graph propagation. DataFrame functions only.

Rules on hosts and paths decide first. Where none fits, the host's place in the
link graph does: personalised PageRank spreads trust from hosts that rules allow
along the host edges, and distrust from hosts that rules block against them. A
host is blocked if its distrust outweighs its trust.
"""

from __future__ import annotations

import string
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rules become literals of the plan, so their number is bounded.
MAX_RULES = 2000
#: Parts of a page that hold no links of its own.
_NOT_SHOWN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_MAYBE_HIDDEN = r"(?i)<(?:!--|script|style)"
_HREF = r"""\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
_LINK, _BASE = r"(?i)<(?:a|area)" + _HREF, r"(?i)<base" + _HREF
#: Named character references that may stand in the part of a link that has the host.
_NAMED = {"&amp;": "&", "&colon;": ":", "&sol;": "/", "&period;": ".", "&hyphen;": "-", "&Tab;": "", "&NewLine;": ""}
_NUMBERED = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?"


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; of equally long ones, block first, then by text."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out: Column | None = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def _decoded(link: Column) -> Column:
    """A link with its character references replaced, as far as the host needs them."""
    for name, char in _NAMED.items():
        link = F.replace(link, F.lit(name), F.lit(char))
    number = lambda r: F.regexp_extract(r, r"&#[xX]?([0-9a-fA-F]+)", 1)
    hexed = lambda r: F.when(r.rlike("^&#[xX]"), number(r)).otherwise(F.conv(number(r), 10, 16))
    char = lambda r: F.decode(F.unhex(F.lpad(hexed(r), 8, "0")), "UTF-32")
    parts = F.split(link, _NUMBERED, -1)
    chars = F.transform(F.regexp_extract_all(link, F.lit(f"({_NUMBERED})"), F.lit(1)), char)
    whole = F.array_join(F.zip_with(parts, chars, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    return F.when(link.contains("&#"), whole).otherwise(link)


def links_of(html: Column) -> Column:
    """Array of the hosts that a page links to by ``a`` and ``area``, each once.

    Links without a scheme have the page's own; links without a host are the
    page's own, too, unless a ``base`` names another host. Character references
    are decoded; links in comments, scripts and styles are none.
    """
    bare = lambda u: F.trim(_decoded(F.regexp_replace(u, r"""(?s)\A(["'])(.*)\1\z""", "$2")))
    whole = lambda u: F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u)
    absolute = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"
    none = F.array().cast("array<string>")

    def of(shown: Column) -> Column:
        def hosts(hrefs: Column) -> Column:
            far = F.transform(F.filter(hrefs, lambda u: u.rlike(absolute)), lambda u: host_of(whole(u)))
            base = F.when(F.contains(F.lower(shown), F.lit("<base")), bare(F.regexp_extract(shown, _BASE, 1)))
            near = F.exists(hrefs, lambda u: ~u.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:|//|#)"))
            own = F.when(base.rlike(absolute) & near, F.array(host_of(whole(base)))).otherwise(none)
            return F.array_distinct(F.concat(far, own))

        return _once(F.transform(F.regexp_extract_all(shown, F.lit(_LINK), F.lit(1)), bare), hosts)

    text = F.coalesce(html, F.lit(""))
    has = F.contains(F.lower(text), F.lit("href"))
    return F.when(has, _once(F.when(text.rlike(_MAYBE_HIDDEN), F.regexp_replace(text, _NOT_SHOWN, " ")).otherwise(text), of)).otherwise(none)


def _once(value: Column, then) -> Column:
    """``then`` of ``value``, which is computed once however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: how many pages of src (host, html) link to dst.

    Links are combined before the shuffle, so a host that has a third of all
    links is one row for each partner and task.
    """
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links_of(F.col("html"))).alias("dst"))
    return links.where("dst <> src AND dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, cut_every: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """(host, rank): rank spread from ``seeds`` (host, seed >= 0) over ``edges`` (src, dst, weight).

    Each round sends ``damping`` of a host's rank along its edges by weight and
    returns the rest to the seeds; rank of hosts without edges ends there. The
    rounds are joins and groupings; every ``cut_every`` rounds the ranks are
    written out, which cuts the lineage. They end after ``rounds``, or, if that is
    None, when since the last writing no host is new and none's rank changed by more
    than ``tolerance`` of itself, so that the summed change is at most ``tolerance``.
    Hosts that no seed reaches have no row.
    """
    total = seeds.agg(F.sum("seed")).first()[0]
    if not total:
        return seeds.select("host", F.lit(0.0).alias("rank")).limit(0)
    start = seeds.where("seed > 0").select("host", (F.col("seed") / total).alias("seed"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("of"))
    flow = materialise(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("of")).alias("part")), "host-flow")
    rank = written = start.select("host", F.col("seed").alias("rank"))
    for k in count(1) if rounds is None else range(1, rounds + 1):
        sent = flow.join(rank, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") * F.col("part")).alias("rank"))
        back = start.select("host", (F.lit(1 - damping) * F.col("seed")).alias("rank"))
        rank = sent.unionByName(back).groupBy("host").agg(F.sum("rank").alias("rank"))
        if k % cut_every == 0 and k != rounds:
            rank = materialise(rank, "host-rank")
            if rounds is None:
                moved = F.abs(F.col("rank") - F.coalesce("before", F.lit(0.0))) > tolerance * F.col("rank")
                if rank.join(written.withColumnRenamed("rank", "before"), "host", "left").where(moved).isEmpty():
                    break
                written = rank
    return rank


def judge_urls(pages: DataFrame, rules: list[Rule], block_share: float = 0.5, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of ``pages`` (page_id, url, html).

    Seeds are hosts of which rules decide over half the pages: they are trusted by
    the number of allowed pages, or distrusted by the number of blocked ones. A
    host with a few blocked pages is no seed. Where no rule fits, a host is blocked if distrust > block_share * (trust + distrust), that
    is, with the default, if distrust is larger; a host that neither reaches is allowed.

    Nulls: a null url has empty host and path, fits no rule and is allowed; a null
    html has no links. Very long pages are read whole. Repeated rows count as
    pages of their own. Empty tables give no rows; other columns are not read.
    """
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    judged = judged.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    slim = materialise(judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("by_rule")), "url-rules")
    edges = materialise(host_edges(judged), "host-edges")
    seeds = materialise(
        slim.where("host <> ''").groupBy("host").agg(
            F.count("*").alias("n"),
            F.count_if(F.col("by_rule") == "allow").cast("double").alias("good"),
            F.count_if(F.col("by_rule") == "block").cast("double").alias("bad"),
        ).where("2 * good > n OR 2 * bad > n"),
        "host-seeds",
    )
    trust = personalised_pagerank(edges, seeds.where("2 * good > n").select("host", F.col("good").alias("seed")), damping, rounds)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = personalised_pagerank(turned, seeds.where("2 * bad > n").select("host", F.col("bad").alias("seed")), damping, rounds)
    by_host = materialise(
        trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust"))
        .unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
        .groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")),
        "host-verdicts",
    )
    out = slim.join(by_host, "host", "left").fillna(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > block_share * (F.col("trust") + F.col("distrust"))
    verdict = F.coalesce("by_rule", F.when(bad, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
