"""URL filters by host reputation: beta-binomial shrinkage from host to registered domain to suffix. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffixes of two labels under which names are registered; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "ne.jp", "co.nz", "co.za", "co.in", "co.kr", "com.br", "com.cn", "com.mx", "com.tr")
#: (verdict, host, path) rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A share of good pages before any label and the labelled pages that it counts for; deviations of the bound from the mean, and the
#: bound from which a host stays.
PRIOR_GOOD, PRIOR_WEIGHT, DEVIATIONS, LEAST_GOOD = 0.5, 8.0, 1.64, 0.5
#: Labelled pages that a level's prior counts for at least and at most; between, the labels tell (strength()).
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
#: A host with this share of all pages or more is joined by broadcast: there are 1 / HOT_SHARE of them at most.
HOT_SHARE = 0.001


def lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_az(host), path


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null. A rule fits its host and all subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def strength(groups: DataFrame, name: str) -> DataFrame:
    """One row with the number of labelled pages that a level's prior counts for, as the spread of its groups tells.

    groups: parent, n labelled pages, g good ones. The share of good pages differs between the groups of a parent with the beta-binomial's
    intraclass correlation r, which is estimated by analysis of variance; the beta prior then counts for 1 / r - 1 pages. Where no parent has
    two labelled groups, or no group two labelled pages, nothing can be told and PRIOR_WEIGHT holds; groups no more apart than chance
    have MOST_WEIGHT."""
    own = groups.where("n > 0").select("parent", F.col("n").cast("double").alias("n"), F.col("g").cast("double").alias("g"))
    # around a parent's share p = G / N: sum of n * (g / n - p) ** 2 is sum of g * g / n less G * G / N
    parents = own.groupBy("parent").agg(F.sum("n").alias("pn"), F.sum("g").alias("pg"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("g") * F.col("g") / F.col("n")).alias("s"), F.count("*").alias("k"))
    total = parents.agg(F.sum("k").alias("k"), F.count("*").alias("p"), F.sum("pn").alias("n"), F.sum("pg").alias("g"), F.sum("s").alias("s"), F.sum(F.col("pg") * F.col("pg") / F.col("pn")).alias("t"), F.sum(F.col("nn") / F.col("pn")).alias("q"))
    between = F.try_divide(F.col("s") - F.col("t"), F.col("k") - F.col("p"))
    within = F.try_divide(F.col("g") - F.col("s"), F.col("n") - F.col("k"))
    size = F.try_divide(F.col("n") - F.col("q"), F.col("k") - F.col("p"))
    r = F.try_divide(between - within, between + (size - 1) * within)
    weight = F.when(r > 0, F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.try_divide(F.lit(1.0), r) - 1))).otherwise(F.lit(MOST_WEIGHT))
    told = (F.col("k") > F.col("p")) & (F.col("n") > F.col("k")) & r.isNotNull()
    return total.select(F.when(told, F.round(weight, 6)).otherwise(F.lit(PRIOR_WEIGHT)).alias(name))


def reputation(pages: DataFrame, good: float = PRIOR_GOOD, weight: float = PRIOR_WEIGHT, deviations: float = DEVIATIONS) -> DataFrame:
    """Per host: pages, labelled pages n, good ones g, posterior mean of the share of good pages and its upper bound.

    pages: host, and good (1, 0 or null: unknown). All labelled pages are shrunk to `good`, which counts for `weight` of them; a suffix's
    share is shrunk to theirs, a registered domain's to its suffix's, a host's to its domain's, each by as many pages as
    strength() finds in the labels for that level. Counts of a level are sums of those of the level below, so rows are gone through once.
    """
    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"), F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    hosts = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "pages", "n", "g")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("g").alias("dg"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dg").alias("sg"))
    total = suffixes.agg(F.sum("sn").alias("tn"), F.sum("sg").alias("tg"))
    base = total.select(((F.col("tg") + weight * good) / (F.col("tn") + weight)).alias("base"))
    levels = (hosts.select(F.col("domain").alias("parent"), "n", "g"), domains.select(F.col("suffix").alias("parent"), F.col("dn").alias("n"), F.col("dg").alias("g")), suffixes.select(F.lit("").alias("parent"), F.col("sn").alias("n"), F.col("sg").alias("g")))
    for level, name in zip(levels, ("hw", "dw", "sw"), strict=True):
        base = base.join(F.broadcast(strength(level, name)))  # one row each
    suffixes = suffixes.join(F.broadcast(base)).select("suffix", "hw", "dw", ((F.col("sg") + F.col("sw") * F.col("base")) / (F.col("sn") + F.col("sw"))).alias("sm"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", "hw", ((F.col("dg") + F.col("dw") * F.col("sm")) / (F.col("dn") + F.col("dw"))).alias("dm"))
    w = F.col("hw")
    a, b = F.col("g") + w * F.col("dm"), F.col("n") - F.col("g") + w * (1 - F.col("dm"))
    mean = a / (a + b)
    bound = mean + F.lit(deviations) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.join(domains, ["domain", "suffix"]).select("host", "pages", "n", "g", mean.alias("mean"), bound.alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, least_good: float = LEAST_GOOD) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the host's posterior mean and upper bound.

    outcomes: page_id and good (1 or 0, null: unknown); of several for a page the lowest holds, and pages with equal
    page_id share it. The longest rule that fits decides; else a host is blocked when even the upper bound of its share
    of good pages is under `least_good`. A host without labels takes its domain's prior. A null url has an empty host,
    which is a host like any other. A page has one row for each of its rows. The few hosts with very many pages are
    joined by broadcast, so that none fills a task.
    """
    host, path = parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = outcomes.select(F.col("page_id").alias("_id"), "good").where("_id IS NOT NULL").groupBy("_id").agg(F.min("good").alias("good"))
    rep = reputation(urls.join(known, F.col("page_id") == F.col("_id"), "left").select("host", "good"))
    many = pages.agg(F.count("*").alias("_all"))
    rep = rep.join(F.broadcast(many)).withColumn("_hot", F.col("pages") >= F.col("_all") * HOT_SHARE).drop("pages", "_all")
    hot = F.broadcast(rep.where("_hot"))
    judged = urls.join(hot, "host").unionByName(urls.join(hot.select("host"), "host", "left_anti").join(rep.where("NOT _hot"), "host"))
    ruled = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("upper") < least_good, "block").otherwise("allow"))
    return judged.withColumn("_r", ruled).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "mean", "upper")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes from the table labels, whose doc_id names the page that a document came from: good if its quality is 1 and it isn't toxic."""
    return labels.select(F.col("doc_id").alias("page_id"), F.when(F.col("quality").isNull() & F.col("toxic").isNull(), None).when((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0).alias("good"))
