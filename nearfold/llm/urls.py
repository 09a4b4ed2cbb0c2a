"""URL filter by rules and link-graph propagation, in DataFrame functions only.

Rules name a host, with its subdomains, and the start of a path; the longest that fits
decides. Pages that no rule fits are judged by their host. Every host has two seeds: the
share of its pages that rules allow and the share that rules block. Both scores of a host
lie between 0 and 1, whatever the size of the graph:

- trust is the share of the host's PageRank that comes from the allowed seeds: the
  personalised PageRank that restarts at them, by the one that restarts at every host;
- distrust runs against the links from the blocked seeds: the chance that a surfer who
  starts at the host, follows a link with probability `damping` and stops otherwise, or
  where there is no link, stops at a blocked page.

A host is blocked if its distrust exceeds its trust by `threshold`.

Host and path are empty for a null url or one without ://. Null html has no links. Pages
are judged row by row, so repeated rows get equal verdicts (repeated links count as
often as they stand). Other columns are kept; output names replace input columns.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import dropped, fresh, stored

#: (verdict, host, start of the path)
Rule = tuple[str, str, str]

#: Absolute targets of anchors, without the scheme. Attributes before href are passed one
#: by one, quoted values included; repetitions are possessive, so none recurses.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|(?!["'])[^\s>]++)"""
LINK = rf"""(?is)<a(?:[\s/]++(?!href[\s]*+=)[^\s=>/"']++(?:\s*+=\s*+{_VALUE})?+)*+[\s/]++href\s*+=\s*+["']?+\s*+(?:https?:)?+(//[^"'\s>]++)"""

#: So many blocked hosts are sent to all executors; more are joined by a shuffle.
BROADCAST_HOSTS = 200_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: str | Column) -> tuple[Column, Column]:
    url = F.col(url) if isinstance(url, str) else url
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)", 1), F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path joined, and its verdict; nulls if
    none does. Of equally long ones, block comes first, then the lesser text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, suffix, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] != "block", r[1] + r[2]), reverse=False):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule, verdict = F.when(fits, suffix + prefix).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def link_shares(pages: DataFrame, host: str, html_col: str) -> DataFrame:
    """src, dst, share: of the links from src to other hosts, those that lead to dst."""
    targets = F.when(F.contains(html_col, F.lit("//")), F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1)))
    links = pages.select(F.col(host).alias("src"), F.explode(targets).alias("to")).where("src <> ''")
    links = links.select("src", host_and_path(F.concat(F.lit("x:"), "to"))[0].alias("dst")).where("dst <> '' and dst <> src")
    counts = stored(links.groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    out = counts.groupBy("src").agg(F.sum("n").alias("all"))
    return counts.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))


def propagate(seeds: DataFrame, shares: DataFrame, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """host, trust, distrust from seeds (host, good, bad) over shares (src, dst, share).
    Ends when no rank or distrust changed by more than `tolerance`, or after `rounds` where
    given. The sum of all changes shrinks by `damping` each round, which bounds the rounds;
    it is an error if they do not suffice."""
    ends = shares.select(F.col("src").alias("host")).unionByName(shares.select(F.col("dst").alias("host")))
    hosts = seeds.unionByName(ends.distinct().withColumns({"good": F.lit(0.0), "bad": F.lit(0.0)})).groupBy("host").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))
    shares = stored(shares, "shares")
    if shares.isEmpty():
        return hosts.select("host", F.col("good").alias("trust"), F.col("bad").alias("distrust"))
    # A surfer stops where no link leads on.
    leaving = shares.select(F.col("src").alias("host")).distinct().withColumn("stop", F.lit(1 - damping))
    hosts = hosts.join(leaving, "host", "left").withColumn("stop", F.coalesce("stop", F.lit(1.0)))
    fixed = ["host", "good", "bad", "stop"]
    scores = ("from_good", "from_all", "distrust")
    start = {"from_good": (1 - damping) * F.col("good"), "from_all": F.lit(1 - damping), "distrust": F.col("stop") * F.col("bad")}
    now = stored(hosts.withColumns(start), "hosts")
    total = max(1.0, float(now.count()))
    most = math.ceil(math.log(tolerance / total) / math.log(damping)) + 2 if rounds is None else rounds
    none = F.lit(0.0)
    for _ in range(most):
        along = lambda c: F.sum(F.col("share") * F.col(c)).alias(c)
        forward = shares.join(now, shares["src"] == now["host"]).groupBy(F.col("dst").alias("host")).agg(along("from_good"), along("from_all"), F.sum(none).alias("distrust"))
        back = shares.join(now, shares["dst"] == now["host"]).groupBy(F.col("src").alias("host")).agg(F.sum(none).alias("from_good"), F.sum(none).alias("from_all"), along("distrust"))
        both = forward.unionByName(back).groupBy("host").agg(*(F.sum(c).alias(f"in_{c}") for c in scores))
        after = now.join(both, "host", "left").select(*fixed, *(F.col(c).alias(f"was_{c}") for c in scores), *((start[c] + damping * F.coalesce(f"in_{c}", none)).alias(c) for c in scores))
        before, now = now, stored(after, "hosts")
        dropped(before)
        moved = now.agg(F.max(F.greatest(*(F.abs(F.col(c) - F.col(f"was_{c}")) for c in scores)))).first()[0] or 0.0
        if moved <= tolerance:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"trust and distrust still move by {moved} after {most} rounds")
    return now.select("host", (F.col("from_good") / F.col("from_all")).alias("trust"), "distrust")


def url_filter(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", html_col: str = "html", threshold: float = 0.5, damping: float = 0.85, rounds: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """pages (or the columns `keep` of it) with host, path, rule and verdict."""
    added = ("host", "path", "rule", "verdict")
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in added]
    host, path = host_and_path(url_col)
    parts = pages.select(*[pages[c] for c in keep], host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": rule, "verdict": verdict})

    by_host = pages.select(host.alias("host"), path.alias("path")).withColumn("verdict", verdict)
    share = lambda kind: F.avg(F.when(F.col("verdict") == kind, 1.0).otherwise(0.0))
    seeds = by_host.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    src = fresh("src_host", pages.columns)
    scores = propagate(seeds, link_shares(pages.select(host.alias(src), pages[html_col].alias("_html")), src, "_html"), damping, rounds)
    bad_host = fresh("bad_host", keep)
    blocked = stored(scores.where(F.col("distrust") - F.col("trust") >= threshold).select(F.col("host").alias(bad_host)), "blocked")
    if blocked.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        blocked = F.broadcast(blocked)
    # A hot host on the pages' side is split by the adaptive skew join.
    out = judged.join(blocked, (judged["host"] == F.col(bad_host)) & judged["rule"].isNull(), "left")
    final = F.coalesce("verdict", F.when(F.col(bad_host).isNotNull(), "block").otherwise("allow"))
    return out.select(*keep, "host", "path", "rule", final.alias("verdict"))
