"""URL verdicts: rules first, then trust and distrust that flow along links between hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import LOWER, UPPER, cut, free_name

#: Host, then path, of an address; and the hosts that absolute links of a page name.
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""

ROUNDS = 8
DAMPING = 0.85
#: A host is blocked when its distrust is over so many times its trust.
OUTWEIGHS = 2.0


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null where none fits.

    A rule is ``(verdict, host/path)``; it fits its host and all hosts below it
    where the path starts with the rule's.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + rest))
        name = F.when(fits, rule).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank over ``links`` from ``seeds``, both directions in one run.

    ``links``: src, dst, weight, kind; ``seeds``: host, kind, seed.  ``kind`` keeps
    the graphs apart: trust runs along the links, distrust against them.  A round
    gives each host ``1 - damping`` of its seed and ``damping`` of its neighbours'
    score, shared by weight.  Two shuffles of host rows a round, both pre-aggregated;
    AQE splits the links of a hub.
    """
    total = links.groupBy("src", "kind").agg(F.sum("weight").alias("total"))
    shares = cut(links.join(total, ["src", "kind"]).select("src", "dst", "kind", (F.col("weight") / F.col("total")).alias("share")))
    base = seeds.select("host", "kind", (F.col("seed") * (1 - damping)).alias("score"))
    scores = base
    for _ in range(rounds):
        at = scores.withColumnRenamed("host", "src")
        passed = at.join(shares, ["src", "kind"]).select(
            F.col("dst").alias("host"), "kind", (F.col("score") * F.col("share") * damping).alias("score")
        )
        scores = base.unionByName(passed).groupBy("host", "kind").agg(F.sum("score").alias("score"))
    return scores


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    url_col: str = "url",
    html_col: str = "html",
    rounds: int = ROUNDS,
    damping: float = DAMPING,
    outweighs: float = OUTWEIGHS,
) -> DataFrame:
    """``pages`` with one struct column ``judged``: host, path, rule, verdict, trust, distrust.

    Hosts with pages that a rule allows seed trust by the share of their ruled
    pages, hosts with blocked pages seed distrust.  Trust follows links, distrust
    goes against them (a page that links to bad hosts is suspect).  Where no rule
    fits, a host is blocked if its distrust is over ``outweighs`` times its trust.
    A host that neither reaches, an address without ``://`` and a null one are
    allowed.  Null or empty html has no links.  Every input row gives one row, and
    other columns pass through; the html is read once, to collect links.
    """
    host, path = host_of(pages[url_col]), path_of(pages[url_col])
    rule, says = rule_of(host, path, rules)
    # Links and counts of ruled pages come out of one pass over the pages.
    found = F.array_distinct(
        F.transform(
            F.coalesce(F.regexp_extract_all(pages[html_col], F.lit(LINK), F.lit(1)), F.array().cast("array<string>")),
            lambda h: F.translate(h, UPPER, LOWER),
        )
    )
    seen = pages.select(
        host.alias("src"),
        F.explode(F.concat(F.array(F.lit(None).cast("string")), found)).alias("dst"),
        says.alias("says"),
    )
    facts = cut(
        seen.filter((F.col("src") != "") & (F.col("dst").isNull() | (F.col("dst") != F.col("src"))))
        .groupBy("src", "dst")
        .agg(
            F.count("*").cast("double").alias("pages"),
            F.count(F.when(F.col("says") == "allow", 1)).alias("allowed"),
            F.count(F.when(F.col("says") == "block", 1)).alias("blocked"),
        )
    )
    ruled = facts.filter(F.col("dst").isNull() & (F.col("allowed") + F.col("blocked") > 0))
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), (F.col(c) / (F.col("allowed") + F.col("blocked"))).alias("seed")) for k, c in enumerate(("allowed", "blocked"))]
    )
    seeds = ruled.select(F.col("src").alias("host"), F.inline(kinds)).filter("seed > 0")
    links = facts.filter(F.col("dst").isNotNull())
    both = links.select("src", "dst", F.lit(0).alias("kind"), F.col("pages").alias("weight")).unionByName(
        links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("kind"), F.col("pages").alias("weight"))
    )
    by_host = propagate(both, seeds, rounds, damping).groupBy("host").agg(
        F.round(F.sum(F.when(F.col("kind") == 0, F.col("score"))), 9).alias("trust"),
        F.round(F.sum(F.when(F.col("kind") == 1, F.col("score"))), 9).alias("distrust"),
    )
    nothing = F.lit(0.0)
    host_flow, judged = free_name(pages, "host_flow"), free_name(pages, "judged_host")
    by_host = by_host.select(
        F.col("host").alias(judged),
        F.struct(F.coalesce("trust", nothing).alias("trust"), F.coalesce("distrust", nothing).alias("distrust")).alias(host_flow),
    )
    joined = pages.withColumn(judged, host).join(by_host, judged, "left")
    trust, distrust = (F.coalesce(F.col(host_flow)[c], nothing) for c in ("trust", "distrust"))
    method = F.when(distrust > trust * outweighs, "block").otherwise("allow")
    host, path = F.col(judged), path_of(F.col(url_col))
    rule, says = rule_of(host, path, rules)
    return joined.select(
        *[F.col(f"`{c}`") for c in pages.columns if c != "judged"],
        F.struct(
            host.alias("host"), path.alias("path"), rule.alias("rule"), F.coalesce(says, method).alias("verdict"),
            trust.alias("trust"), distrust.alias("distrust"),
        ).alias("judged"),
    )
