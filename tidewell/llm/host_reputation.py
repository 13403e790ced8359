"""URL filters by empirical-Bayes host reputation.

Labelled pages (bad: quality 0 or toxic 1) are counted per host, registered domain and suffix. Each level is a
beta-binomial around the level above: its strength comes from the moments of the level's rates (intra-class correlation),
its mean shrinks from suffix to domain to host. A host is blocked when the lower bound of its posterior bad rate (mean less
BOUND_Z standard deviations) is over MOST_BAD. Explicit rules come first: a rule fits its host and all subdomains when the
path starts with the rule's path, and the longest that fits wins.

The suffix is the last label, or the last two where they are one of suffixes (a parameter; SUFFIXES by default); the
registered domain has one label more. User information and port aren't part of them, and an address of numbers is a domain
of its own, under no suffix.

Defined results: a url that is null or lacks :// has an empty host and path (a host like any other); several labels of a
page count as one, bad if any is; labels with neither quality nor toxic don't count; hosts without labels have their
domain's rate; no labels at all block nothing; an empty table gives no rows. Rows that repeat (also the page_id alone) are
judged alike and each counts. Other columns of pages and labels aren't read. Counts are summed before the shuffle, and
the pages of a host, the hosts of a domain and the domains of a suffix that are very many are dealt over tasks, so one
host may hold any share of the pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import ascii_lower, beside, cut, meet

BOUND_Z = 1.645
MOST_BAD = 0.5
#: Bounds of the intra-class correlation.
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: Public suffixes of two labels.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "co.in", "co.kr", "com.mx", "co.nz", "com.tr", "com.tw", "co.za", "github.io", "blogspot.com")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


#: The rules of the url query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def _fits(rule: Rule) -> Column:
    return ((F.col("host") == rule.host) | F.endswith(F.col("host"), F.lit("." + rule.host))) & F.startswith(F.col("path"), F.lit(rule.path))


def _strength(counts: DataFrame) -> DataFrame:
    """One row (m, rate): the strength of the beta prior from the moments of the rates, and the overall rate."""
    seen = counts.where("n > 0")
    s = seen.agg(F.count("*").alias("k"), F.sum("n").alias("t"), F.sum("bad").alias("b"), F.sum(F.col("n") * F.col("n")).alias("t2"), F.sum(F.col("bad") * F.col("bad") / F.col("n").cast("double")).alias("b2"))
    p = F.expr("(coalesce(b, 0) + 0.5) / (coalesce(t, 0) + 1.0)").cast("double")
    s = s.withColumn("rate", p)
    spread = F.expr("(b2 - 2 * rate * b + rate * rate * t) / (rate * (1 - rate))")
    size = F.expr("t - t2 / CAST(t AS DOUBLE)")
    rho = F.when((F.col("k") > 1) & (size - (F.col("k") - 1) > 1e-9), (spread - (F.col("k") - 1)) / (size - (F.col("k") - 1))).otherwise(F.lit(LEAST_RHO))
    rho = F.least(F.greatest(rho, F.lit(LEAST_RHO)), F.lit(MOST_RHO))
    return s.select((1 / rho - 1).alias("m"), "rate")


def host_levels(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix)."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    number = F.regexp_like(bare, F.lit(r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"))
    two = F.regexp_extract(bare, r"[^.]*\.[^.]*$", 0)
    wide = two.isin(*suffixes) if suffixes else F.lit(False)
    domain = F.when(number, bare).when(wide, F.regexp_extract(bare, r"([^.]*\.)?[^.]*\.[^.]*$", 0)).otherwise(F.regexp_extract(bare, r"([^.]*\.)?[^.]*$", 0))
    return domain, F.when(number, F.lit("")).when(wide, two).otherwise(F.regexp_extract(bare, r"[^.]*$", 0))


def host_bounds(pages: DataFrame, labels: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """host, pages, n_labelled, n_bad, bad_bound for every host of pages (page_id, host), as a stored table."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcome = labels.select(F.col("doc_id").alias("page"), bad.alias("bad")).where("bad IS NOT NULL AND page IS NOT NULL").groupBy("page").agg(F.max("bad").alias("bad"))
    # pages meet their labels by page_id, which no page shares with many
    per = pages.join(outcome, F.col("page_id") == F.col("page"), "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pages"))
    domain, suffix = host_levels(F.col("host"), suffixes)
    per = cut(per.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = cut(per.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("below")), "domains")
    tops = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("below")), "suffixes")
    # one row of two numbers for each level
    (m_s, _), (m_d, _), (m_h, rate) = (tuple(_strength(t).first()) for t in (tops, domains, per))
    s = tops.select("suffix", ((F.col("bad") + m_s * rate) / (F.col("n") + m_s)).alias("mean_s"))
    d = meet(domains, s, ["suffix"], tops.select("suffix", F.col("below").alias("n")), "domain")
    d = d.select("domain", "suffix", ((F.col("bad") + m_d * F.col("mean_s")) / (F.col("n") + m_d)).alias("mean_d"))
    h = meet(per, d, ["domain", "suffix"], domains.select("domain", "suffix", F.col("below").alias("n")), "host")
    a, b = F.col("bad") + m_h * F.col("mean_d"), F.col("n") - F.col("bad") + m_h * (1 - F.col("mean_d"))
    h = h.withColumn("a", a).withColumn("b", b)
    bound = F.expr(f"a / (a + b) - {BOUND_Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))")
    return cut(h.select("host", "pages", F.col("n").alias("n_labelled"), F.col("bad").cast("long").alias("n_bad"), bound.alias("bad_bound")), "bounds")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad per row of pages (page_id, url)."""
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    bounds = host_bounds(rows.select("page_id", "host"), labels, suffixes)
    order = sorted(rules, key=lambda r: (-len(str(r)), str(r)))
    rule = F.coalesce(*(F.when(_fits(r), F.lit(str(r))) for r in order)) if order else F.lit(None).cast("string")
    ruled = F.coalesce(*(F.when(_fits(r), F.lit(r.verdict)) for r in order)) if order else F.lit(None).cast("string")
    out = beside(rows, bounds.drop("pages"), ["host"], bounds.select("host", F.col("pages").alias("n")), "page_id")
    own = F.when(F.col("bad_bound") > MOST_BAD, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"), "n_labelled", "n_bad")
