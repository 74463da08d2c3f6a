"""URL filter by empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are summed by host, registered domain and suffix. Each
level's bad rate is shrunk towards the level above through a beta-binomial prior whose strength
is estimated from the spread of the children around their parents; a host is blocked when the
lower bound of its posterior bad rate passes a limit. Fixed rules come first.

Null urls and urls without ``://`` have an empty host and path, which is judged like any other
host. Pages without an outcome count for nothing but are judged; an outcome without a page is
ignored; repeated outcomes of one page id each count, and so does each of several pages of one id.
With no outcomes at all every prior is flat. An empty table of pages gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatherum.session import cut

#: (action, rule): a host, then a path prefix.
RULES = (
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
)
#: Suffixes of two labels; any other suffix is the last label.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: A prior's strength in pages: between one page and a million.
WEAKEST, STRONGEST = 1.0, 1e6


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of ``rule`` and ``action``; null if none does."""
    best = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(best)
    return best


def _strength(children: DataFrame) -> Column:
    """Prior strength from (n, k, parent rate m): the moment estimate of the overdispersion."""
    m = F.greatest(F.least(F.col("m"), F.lit(1 - 1e-6)), F.lit(1e-6))
    z = F.pow(F.col("k") - F.col("n") * m, 2) / (F.col("n") * m * (1 - m))
    rho = F.sum(F.when(F.col("n") > 1, z - 1)) / F.sum(F.when(F.col("n") > 1, F.col("n") - 1))
    rho = F.coalesce(rho, F.lit(0.0))
    return F.greatest(
        F.lit(WEAKEST), F.least(F.lit(STRONGEST), 1 / F.greatest(rho, F.lit(1e-6)) - 1)
    )


def _shrunk(children: DataFrame) -> DataFrame:
    """Adds ``a`` and ``b`` of the posterior beta, given the parent's rate ``m``."""
    prior = children.agg(_strength(children).alias("s"))  # one row
    mixed = children.join(F.broadcast(prior))
    return mixed.withColumn("a", F.col("k") + F.col("m") * F.col("s")).withColumn(
        "b", F.col("n") - F.col("k") + (1 - F.col("m")) * F.col("s")
    )


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``(host, n, k, a, b)`` for every host of ``pages (page_id, url)``.

    ``outcomes (page_id, bad)``: bad is 0 or 1. ``n`` pages of the host are labelled, ``k`` of
    them bad; the bad rate's posterior is Beta(a, b).
    """
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"))
    marks = outcomes.filter(F.col("bad").isNotNull()).select("page_id", F.col("bad").cast("long").alias("bad"))
    counts = marks.groupBy("page_id").agg(F.count("bad").alias("n"), F.sum("bad").alias("k"))
    hosts = (
        seen.join(counts, "page_id", "left")
        .groupBy("host")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
    )
    hosts = cut(hosts)  # read once for each level and for each level's strength
    total = lambda of, *by: of.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    per_domain = cut(total(hosts, "suffix", "domain"))
    per_suffix = cut(total(per_domain, "suffix"))
    root = per_suffix.agg(((F.sum("k") + 0.5) / (F.sum("n") + 1)).alias("m"))
    suffixes = _shrunk(per_suffix.join(F.broadcast(root)))
    up = suffixes.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    domains = _shrunk(per_domain.join(up, "suffix"))
    up = domains.select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))
    return _shrunk(hosts.join(up, "domain")).select("host", "n", "k", "a", "b")


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """Lower posterior bound of a Beta(a, b) rate: ``z`` standard deviations below its mean."""
    mean = a / (a + b)
    return F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1)))


def judge(
    pages: DataFrame, outcomes: DataFrame, max_bad: float = 0.5, z: float = 1.645, rules=RULES,
) -> DataFrame:
    """Verdict for every page: the fixed rule's, else block if the host's bound passes ``max_bad``."""
    known = reputations(pages, outcomes).select(
        "host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"),
        lower_bound(F.col("a"), F.col("b"), z).alias("bound"),
    )
    own = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rule = matched_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bound") > max_bad, "block").otherwise("allow")
    return (
        own.join(known, "host", "left")
        .withColumn("fit", rule)
        .select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"),
            F.coalesce(F.col("fit.action"), learned).alias("verdict"),
            "n_labelled", "n_bad", F.round("bound", 6).alias("bad_bound"),
        )
    )
