"""URL filter by empirical-Bayes host reputation, with rules of hosts and paths before it.

Labelled pages give good and bad outcomes per host. A host's rate of good pages is shrunk towards that of its
registered domain, the domain's towards that of its suffix, and the suffix's towards that of all pages, by
beta-binomial priors: a level's prior has the mean of the level above, and a strength estimated from the spread of
the rates at its own level (method of moments). The verdict follows from a bound of the host's beta posterior: a
host is blocked if the upper bound of its rate of good pages is below ``least_good``. Hosts without labelled pages
take the posterior of the level above. Each level is written once, so the plan of a level does not hold those above.

Rules come first: the longest whose host is the page's or above it, and whose path begins the page's.

Defined results: a null URL, or one without ``://``, has an empty host and path and the prior of all pages; with no
labelled pages every prior is even; repeated rows each give a row; hosts are compared as they stand after A-Z are
lower-cased, with port and user name if there are any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import cut, join_counted

#: Fixed values of the query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Blocked if even the upper bound (this many standard deviations above the mean) is below ``LEAST_GOOD``.
LEAST_GOOD, DEVIATIONS = 0.5, 1.645
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 2.0, 200.0
#: A domain is registered under two labels where the last has two letters and the one before is one of these, ...
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: ... and under suffixes of two labels given as such.
SUFFIXES = ()
_ADDRESS = r"^[0-9.]+(:[0-9]*)?$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_two(host: Column, suffixes) -> Column:
    """Whether the suffix of a host has two labels."""
    two = F.substring_index(host, ".", -2)
    listed = two.isin(*suffixes) if suffixes else F.lit(False)
    return two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$") | listed


def suffix_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The last label, or the last two where domains are registered under those; an IP address is its own."""
    name = F.when(_by_two(host, suffixes), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    return F.when(host.rlike(_ADDRESS), host).otherwise(name)


def domain_of(host: Column, suffixes=SUFFIXES) -> Column:
    """The registered domain: the suffix and one label before it; an IP address is its own."""
    name = F.when(_by_two(host, suffixes), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(host.rlike(_ADDRESS), host).otherwise(name)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The longest rule last, so that it decides; of rules equally long the first given.
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _level(rows: DataFrame, key: str, prior: DataFrame | None, up: str | None) -> DataFrame:
    """A written table (key, alpha, beta, mean) from counts (good, n), shrunk towards the means of ``prior`` by ``up``.

    The strength of the prior is one number; it comes to the driver.
    """
    counts = rows.groupBy(key, *([up] if up else [])).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    if up:
        counts = counts.join(prior.select(F.col("key").alias(up), F.col("mean").alias("m")), up)
    counts = cut(counts if up else counts.withColumn("m", F.lit(0.5)))
    m, n = F.col("m"), F.col("n")
    # Method of moments: the variance of rates beyond that of binomial draws gives 1 / (strength + 1).
    spread = F.sum(n * (F.col("good") / n - m) ** 2) / F.nullif(F.sum(m * (1 - m)), F.lit(0.0))
    mean_n = F.sum(n) / F.nullif(F.count("*").cast("double"), F.lit(0.0))
    rho = counts.agg(((spread - 1) / F.nullif(mean_n - 1, F.lit(0.0))).alias("rho")).first()["rho"]
    s = STRONGEST if rho is None or rho <= 0 else min(max(1 / rho - 1, WEAKEST), STRONGEST)
    alpha, beta = s * m + F.col("good"), s * (1 - m) + n - F.col("good")
    return counts.select(F.col(key).alias("key"), alpha.alias("alpha"), beta.alias("beta"), (alpha / (alpha + beta)).alias("mean"))


def reputations(outcomes: DataFrame, suffixes=SUFFIXES) -> dict[str, DataFrame]:
    """Posteriors by level from rows (host, good, n): ``host``, ``domain``, ``suffix`` and ``all``."""
    host = F.col("host")
    rows = cut(outcomes.select("host", "good", "n", domain_of(host, suffixes).alias("domain"), suffix_of(host, suffixes).alias("suffix"), F.lit("*").alias("all")))
    out: dict[str, DataFrame] = {}
    for key, up in (("all", None), ("suffix", "all"), ("domain", "suffix"), ("host", "domain")):
        out[key] = _level(rows, key, out.get(up), up)
    return out


def outcomes_of(pages: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(host, good, n): labelled outcomes per host. A page's document is the number that its path ends with; it is
    good if its quality is 1 and it is not toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html?)?/?$", 1)
    numbered = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number).cast("bigint").alias("_doc"))
    good = labels.where(F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("_doc")).agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("bigint")).alias("good"))
    met = numbered.where(F.col("_doc").isNotNull() & (F.col("host") != "")).join(good, "_doc")
    return met.groupBy("host").agg(F.sum("good").alias("good"), F.count("*").alias("n"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, least_good: float = LEAST_GOOD, deviations: float = DEVIATIONS, suffixes=SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, mean, upper) of each row: its host's posterior mean of good pages and upper bound."""
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    levels = reputations(outcomes, suffixes)
    # Hosts that occur, each once, with the posterior of the lowest level that knows them.
    host = F.col("host")
    hosts = rows.groupBy("host").count().select("host", "count", domain_of(host, suffixes).alias("domain"), suffix_of(host, suffixes).alias("suffix"), F.lit("*").alias("all"))
    for level in ("host", "domain", "suffix", "all"):
        known = levels[level].select(F.col("key").alias(level), F.struct("alpha", "beta").alias(f"_{level}"))
        hosts = hosts.join(known, level, "left")
    post = F.coalesce(*[F.col(f"_{x}") for x in ("host", "domain", "suffix", "all")], F.struct(F.lit(1.0).alias("alpha"), F.lit(1.0).alias("beta")))
    a, b = post["alpha"], post["beta"]
    mean = a / (a + b)
    upper = F.least(F.lit(1.0), mean + deviations * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1))))
    judged = join_counted(rows, cut(hosts.select("host", "count", mean.alias("mean"), upper.alias("upper"))), "host", "count")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("upper") < least_good, "block").otherwise("allow")
    return judged.select(F.col("_id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "mean", "upper")
