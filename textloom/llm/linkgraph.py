"""URL filters: rules by host and path, and for all other pages trust and distrust propagated over the graph of host links.

DataFrame expressions only. Trust is personalised PageRank from hosts with allowed pages along links; distrust starts at hosts
with blocked pages and runs against links, to those that link to them. Each host's share of distrust is held against a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import discard, stored, table

#: Production rules: (verdict, host with its subdomains, start of the path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
DAMPING, STORE_EVERY, THRESHOLD = 0.85, 5, 0.5
#: Rounds end once STORE_EVERY of them move less than this share of all rank.
TOLERANCE = 1e-4
#: A host is hot if it has more than HOT links and more than 1 / HOT_HOSTS of all, so that there are 2 * HOT_HOSTS of them at most; links of hot hosts are dealt out by SALTS salts.
HOT, HOT_HOSTS, SALTS = 100_000, 1000, 64
#: Absolute links of a page, whose hosts are read as a page's own url is; and names of hosts that stand anywhere in it.
LINK = r"(?i)[a-z][a-z0-9+.-]*(://[^\s\"'<>/?#]+)"
HOST_NAME = r"(?i)(?<![\w.-])((?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,})(?![\w-])"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the page's or a domain above it and whose path starts the page's; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links and mentions between different hosts of `pages` (host, html), counted; dst are hosts that have pages.

    Each page counts once for a host that it links to or names. Hosts of absolute links are cut out as those of urls are, so
    ports, user names and letters beyond ASCII stay with them; besides, dotted names in the text count.
    """
    # a page's names are made distinct before anything is shuffled; links of one pair of hosts are added up map-side
    linked = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), host_of)
    named = F.transform(F.regexp_extract_all("html", F.lit(HOST_NAME), F.lit(1)), ascii_lower)
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.array_union(linked, named)).alias("dst"))
    edges = found.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return edges.join(pages.where("host <> ''").select(F.col("host").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "n")


def propagated(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from stored seeds (host, good, bad) with both columns summing to 1 or 0, and stored links (src, dst, n).

    x = (1 - d) s + d W x, iterated from s until it stands still, with W the shares of a host's links; distrust uses the shares
    of a host's incoming links, backwards. A host without links passes nothing on: giving its rank back to the seeds would only
    scale all ranks alike, so the result is scaled to sum 1 instead. Links are summed by host with partial sums, and each host
    divides what it sends; a round is one join on the sending host and one sum by receiving host. Hot hosts' links are salted.
    """
    base = seeds.select("host", (F.col("good") * (1 - damping)).alias("trust"), (F.col("bad") * (1 - damping)).alias("distrust"))
    rank = base
    total = links.agg(F.count("*")).first()[0]
    if total:
        zero = F.lit(0).cast("long")
        ends = links.select(F.col("src").alias("host"), F.col("n").alias("out"), zero.alias("come")).unionByName(links.select(F.col("dst").alias("host"), zero.alias("out"), F.col("n").alias("come")))
        degree = stored(ends.groupBy("host").agg(F.sum("out").alias("out"), F.sum("come").alias("come"), F.count("*").alias("links")))
        # at most 2 * HOT_HOSTS rows
        hot = F.broadcast(degree.where(F.col("links") > max(HOT, total / HOT_HOSTS)).select("host", F.lit(True).alias("hot")))
        flow = links.select(F.col("src").alias("host"), F.col("dst").alias("to"), F.col("n").alias("t"), zero.alias("u"))
        back = links.select(F.col("dst").alias("host"), F.col("src").alias("to"), zero.alias("t"), F.col("n").alias("u"))
        both = flow.unionByName(back).groupBy("host", "to").agg(F.sum("t").alias("t"), F.sum("u").alias("u")).join(hot, "host", "left")
        both = stored(both.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("to"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot"))
        share = lambda c, n: F.coalesce(F.col(c) * damping / F.nullif(n, F.lit(0)), F.lit(0.0)).alias(c)
        salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
        kept, change = stored(rank), None
        while change is None or change > tolerance:
            rank = kept
            for _ in range(STORE_EVERY):
                sender = rank.join(degree, "host").join(hot, "host", "left").select("host", share("trust", F.col("out")), share("distrust", F.col("come")), salts)
                sent = sender.join(both, ["host", "salt"]).select(F.col("to").alias("host"), (F.col("trust") * F.col("t")).alias("trust"), (F.col("distrust") * F.col("u")).alias("distrust"))
                rank = base.unionByName(sent).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
            now = stored(rank)
            moved = now.unionByName(kept.select("host", (-F.col("trust")).alias("trust"), (-F.col("distrust")).alias("distrust"))).groupBy("host").agg(F.sum("trust").alias("t"), F.sum("distrust").alias("u"))
            change = moved.agg(F.coalesce(F.sum(F.abs("t") + F.abs("u")), F.lit(0.0))).first()[0]
            discard(kept)
            kept = now
        rank = kept
    sums = rank.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("u")).first()
    return rank.select("host", (F.col("trust") / F.lit(sums["t"] or 1.0)).alias("trust"), (F.col("distrust") / F.lit(sums["u"] or 1.0)).alias("distrust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of each row of pages.

    Without a fitting rule a page is blocked if its host's distrust / (trust + distrust + the host's share of all pages) is above
    the threshold: one blocked page among many doesn't condemn a host. Hosts that neither reaches are allowed. Null urls, and those without `://`, have an empty host and path, which no
    rule and no link reaches. Null html has no links. Repeated rows count again; other columns are ignored; empty tables stay empty.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    told = own.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    # one row a host, from partial counts
    seeds = told.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("good"), F.count(F.when(F.col("verdict") == "block", 1)).alias("bad"), F.count("*").alias("pages"))
    seeds = stored(seeds)
    total = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.sum("pages").alias("pages")).first()
    share = seeds.select("host", (F.col("good") / F.lit(float(total["good"] or 1))).alias("good"), (F.col("bad") / F.lit(float(total["bad"] or 1))).alias("bad"))
    links = host_links(pages.select(host.alias("host"), "html"))
    sizes = seeds.select("host", (F.col("pages") / F.lit(float(total["pages"] or 1))).alias("size"))
    ranks = stored(propagated(stored(share), stored(links)).join(sizes, "host"))
    doubt = F.col("distrust") / (F.col("trust") + F.col("distrust") + F.col("size"))
    method = F.when(doubt > threshold, "block").otherwise("allow")
    return told.join(ranks, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "trust", "distrust")


def op6_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
