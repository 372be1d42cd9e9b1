"""URL verdicts from rules and from empirical-Bayes host reputations.

Labelled page outcomes (bad or not) are counted per host. The rate of a host is shrunk towards that of its registered
domain, which is shrunk towards that of its suffix, and that towards the overall rate: at each level the prior is a beta
distribution around the level above, of a strength fitted from the counts by the beta-binomial's moments. A page is
blocked where the lower posterior bound of its host's bad rate is above a limit: where the beta posterior leaves less than
``chance`` to rates up to the limit, which is the same. Hosts without labels have the posterior of what is above them. Rules
come first, the longest that fits.

Everything is native: counts are aggregated by host before anything is joined, and pages meet the table of hosts in one
join, broadcast only up to ``broadcast_hosts`` hosts and otherwise a sort-merge join that adaptive execution can split.

Cases: a null url or one without ``://`` has an empty host and path and shares the reputation of the empty host; null
outcomes do not count; several outcomes of a page count each; without outcomes every page without a rule is allowed; rows
that repeat a page_id are judged each; no pages give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._spark import stored
from strandlake.llm._text import quoted

#: Fixed rules: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Second-level names that make a suffix together with a two-letter country.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "ne", "or", "org")
LIMIT, CHANCE, BROADCAST_HOSTS = 0.5, 0.05, 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def registered(host: Column, suffixes: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Registered domain and suffix of a host.

    The suffix is the longest of ``suffixes`` that the host ends with (as "github.io"), else its last two labels under a
    country's second level, else its last; the domain has one label more. A numeric address is its own domain.
    """
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*\z", "")
    wide = name.rlike(r"(?:^|\.)(?:" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2}\z")
    address = name.rlike(r"^[0-9.]+\z|^\[")
    labels = F.when(wide, 2).otherwise(1)
    if suffixes:
        n = F.size(F.split(name, r"\."))
        ends = F.filter(F.sequence(n, F.lit(1)), lambda i: F.call_function("substring_index", name, F.lit("."), -i).isin(*suffixes))
        labels = F.coalesce(F.get(ends, F.lit(0)), labels)
    last = lambda k: F.call_function("substring_index", name, F.lit("."), -k)
    return F.when(address, name).otherwise(last(labels + 1)), F.when(address, F.lit("address")).otherwise(last(labels))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of positive numbers, by Stirling's series eight further on."""
    z = x + 8
    steps = F.log(x)
    for i in range(1, 8):
        steps = steps + F.log(x + i)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    return (z - 0.5) * F.log(z) - z + 0.918938533204672742 + series - steps


def beta_below(a: Column, b: Column, x: float) -> Column:
    """The share of a beta distribution up to x (the regularised incomplete beta function), by its continued fraction."""
    tiny = 1e-300

    def fraction(p: Column, q: Column, at: float) -> Column:
        safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

        def term(s: Column, v: Column) -> Column:
            c, d = safe(1 + v / s["c"]), 1 / safe(1 + v * s["d"])
            return F.struct((s["h"] * c * d).alias("h"), c.alias("c"), d.alias("d"))

        def step(s: Column, i: Column) -> Column:
            m = F.floor(i / 2).cast("double")  # terms of even and odd number in turn
            even = m * (q - m) * at / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * at / ((p + 2 * m) * (p + 2 * m + 1))
            return term(s, F.when(i % 2 == 0, even).otherwise(odd))

        zero = F.struct(*(v.cast("double").alias(k) for k, v in (("h", 1 / safe(1 - (p + q) * at / (p + 1))), ("c", F.lit(1.0)), ("d", 1 / safe(1 - (p + q) * at / (p + 1))))))
        count = (120 + 12 * F.sqrt(p + q)).cast("int")
        return F.aggregate(F.sequence(F.lit(2), count), zero, step)["h"]

    front = lambda p, q, at: F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(F.lit(at)) + q * F.log(F.lit(1 - at))) / p
    return F.when(F.lit(x) < (a + 1) / (a + b + 2), front(a, b, x) * fraction(a, b, x)).otherwise(1 - front(b, a, 1 - x) * fraction(b, a, 1 - x))


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def strength(table: DataFrame, mean: str) -> float:
    """The prior's strength (alpha + beta) by moments: how far counts (n, k) spread around ``mean`` beyond chance."""
    v = F.col(mean) * (1 - F.col(mean))
    row = table.where("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col(mean), 2)).alias("s"), F.sum(v).alias("v"), F.sum((F.col("n") - 1) * v).alias("w")).first()
    if not row["w"] or row["w"] <= 0:
        return 1.0
    rho = min(max((row["s"] - row["v"]) / row["w"], 1e-3), 0.5)
    return 1 / rho - 1


def reputations(hosts: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(host, alpha, beta) of the posterior of each row of (host, n, k): labelled pages and bad ones among them."""
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_hosts else df
    domain, suffix = registered(F.col("host"), suffixes)
    hosts = stored(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    n, k = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))).first()
    overall = (k + 0.5) / (n + 1)
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    shrunk = lambda mean, m: (F.col("k") + F.lit(m) * F.col(mean)) / (F.col("n") + F.lit(m))
    suffixes = hosts.groupBy("suffix").agg(*counts).withColumn("above", F.lit(overall))
    suffixes = stored(suffixes.select("suffix", shrunk("above", strength(suffixes, "above")).alias("above")))
    domains = stored(hosts.groupBy("domain", "suffix").agg(*counts).join(small(suffixes), "suffix"))
    domains = stored(domains.select("domain", "suffix", shrunk("above", strength(domains, "above")).alias("above")))
    hosts = stored(hosts.join(small(domains), ["domain", "suffix"]))
    m = strength(hosts, "above")
    return hosts.select("host", (F.col("k") + m * F.col("above")).alias("alpha"), (F.col("n") - F.col("k") + m * (1 - F.col("above"))).alias("beta"))


def judge(pages: DataFrame, outcomes: DataFrame, *, page_id: str = "page_id", url: str = "url", outcome_id: str = "page_id", bad: str = "bad", rules=RULES, limit: float = LIMIT, chance: float = CHANCE, suffixes: tuple[str, ...] = (), broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """A row for each page: page_id, host, path, rule, verdict, bad_rate (the posterior mean) and below (the posterior's share up to the limit).

    outcomes: ids of pages and whether they are bad (boolean). A page is blocked where its host's ``below`` is less than
    ``chance``. suffixes: public suffixes of several labels, whose domains are registered one by one.
    """
    host, path = parsed(F.col(quoted(url)))
    base = pages.select(F.col(quoted(page_id)).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    known = outcomes.select(F.col(quoted(outcome_id)).alias("page_id"), F.col(quoted(bad)).alias("bad")).where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("k"))
    hosts = base.select("page_id", "host").join(known, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    a, b = F.col("alpha"), F.col("beta")
    table = stored(reputations(hosts, broadcast_hosts, suffixes).select("host", (a / (a + b)).alias("bad_rate"), beta_below(a, b, limit).alias("below")))
    joined = base.join(F.broadcast(table) if table.count() <= broadcast_hosts else table, "host", "left")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    return joined.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("below") < chance, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "bad_rate", "below")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages; a page's outcome is the label of its id, bad where quality is 0 or toxic is 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), outcomes).drop("bad_rate", "below")
