"""URL filters: explicit rules, then trust and distrust propagated over host links.

Rules name a host with its subdomains and the beginning of a path; the longest that fits a url decides. For urls
without a rule the host decides: personalised PageRank flows along host links from hosts with allowed pages (trust),
and against host links from hosts with blocked pages (distrust). A host is blocked if its share of distrust in both
exceeds a threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.llm.tables import ascii_lower, discard, stored

# Verdict, host, beginning of the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-9, 0.5
LINK = r"(?i:href|src)\s*=\s*[\"']?\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\s\"'<>]+)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or end, lower-case; path up to ``?``, ``#`` or end.

    Both are empty if the url is null or has no ``://``.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    before = F.substring_index(F.substring_index(rest, "#", 1), "?", 1)
    host = F.substring_index(before, "/", 1)
    return ascii_lower(host), F.substr(before, F.char_length(host) + 1)


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from absolute and scheme-relative references in ``html``."""
    host, _ = split_url(F.col("url"))
    targets = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    links = pages.select(host.alias("src"), F.explode(targets).alias("target")).select("src", ascii_lower(F.col("target")).alias("dst"))
    return links.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, kind, score): personalised PageRank of each ``kind`` of ``seeds`` (host, kind, mass).

    trust follows links, distrust goes against them. Masses of a kind are scaled to 1; what reaches a host without
    a way on returns to the seeds. Stops when the scores change by less than ``tolerance`` in all; a round shrinks the
    change by ``damping`` at least, so that happens after at most log(tolerance / 4) / log(damping) rounds, on cycles too.
    """
    ways = links.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit("trust").alias("kind"), "n")
    ways = ways.union(links.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit("distrust").alias("kind"), "n"))
    out = ways.groupBy("host", "kind").agg(F.sum("n").alias("all"))
    ways = stored(ways.join(out, ["host", "kind"]).select("host", "kind", "to", (F.col("n") / F.col("all")).alias("share")), "ways")
    sums = {r.kind: r.mass for r in seeds.groupBy("kind").agg(F.sum("mass").alias("mass")).collect()}
    scale = F.lit(1.0)
    for kind, mass in sums.items():
        scale = F.when(F.col("kind") == kind, F.lit(float(mass))).otherwise(scale)
    start = stored(seeds.select("host", "kind", (F.col("mass") / scale).alias("seed")), "seeds")
    scores = started = start.withColumnRenamed("seed", "score")
    if ways.isEmpty():
        return scores
    while True:
        moved = scores.join(ways, ["host", "kind"]).groupBy(F.col("to").alias("host"), "kind").agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        moved = stored(moved, "moved")
        kept = {r.kind: r.got for r in moved.groupBy("kind").agg(F.sum("got").alias("got")).collect()}
        # What does not flow on, by damping or for want of a way, starts again at the seeds.
        again = F.lit(1.0)
        for kind, got in kept.items():
            again = F.when(F.col("kind") == kind, F.lit(1.0 - damping * float(got))).otherwise(again)
        each = start.select("host", "kind", (F.col("seed") * again).alias("score")).union(moved.select("host", "kind", (F.col("got") * damping).alias("score")))
        after = stored(each.groupBy("host", "kind").agg(F.sum("score").alias("score")), "scores")
        old = scores.select("host", "kind", (-F.col("score")).alias("score"))
        change = after.union(old).groupBy("host", "kind").agg(F.sum("score").alias("d")).agg(F.sum(F.abs("d"))).first()[0]
        discard(moved, *(() if scores is started else (scores,)))
        scores = after
        if (change or 0.0) < tolerance:
            return scores


def judge_urls(pages: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    Without a rule, a page of a host is blocked if distrust / (trust + distrust) exceeds ``threshold``, else allowed;
    hosts that no seed reaches, and urls without a host, are allowed. Null html has no links. Repeated rows are judged
    each and count as pages of their own. An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = stored(split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")), "judged")
    kind = F.when(F.col("ruled") == "allow", "trust").otherwise("distrust")
    seeds = stored(judged.where("ruled IS NOT NULL").groupBy("host", kind.alias("kind")).agg(F.count(F.lit(1)).cast("double").alias("mass")), "seeds")
    scores = propagate(stored(host_links(pages), "links"), seeds)
    by_host = scores.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    share = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9)
    blocked = stored(by_host.where(share > threshold).select("host", F.lit("block").alias("by_host")), "blocked")
    out = judged.join(blocked, "host", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_host", F.lit("allow")).alias("verdict"))
