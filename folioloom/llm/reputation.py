"""URL filter: rules by host and path, and otherwise an empirical-Bayes reputation of the host.

Labelled pages count as good or bad. The bad rate of a host is shrunk to that of its registered domain, that of the domain to its
suffix, and that of the suffix to all pages. Each level is a beta-binomial whose overdispersion is fitted by moments: with
z = n (bad / n - m)^2 / (m (1 - m)) for a unit of n pages below a prior mean m, z is 1 + (n - 1) rho on average. Were the parent's rate
known, its prior would weigh (1 - rho) / rho = w pages. It is known from e pages only (the parent's own and what its prior weighs, at most all
labelled pages), so the variances 1 / w and 1 / e add up and the prior weighs 1 / (1 / w + 1 / e): never more than the labels behind it.
A host is blocked when the lower bound of its posterior bad rate is above the tolerated rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.operators.skew import fits_broadcast, stored

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bad pages that are tolerated, and how many standard deviations the posterior must clear that by.
MAX_BAD_RATE, DEVIATIONS = 0.25, 1.645
#: Bounds of the fitted overdispersion: a prior weighs between 1 and 999 pages.
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: Rules (host, path, verdict) of the registered query.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?` or `#`, A-Z lower-cased; empty without `://` or for NULL."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def domain_of(host: Column, double_suffixes: Sequence[str] = ()) -> Column:
    """Last two labels; last three below one of `double_suffixes` (such as `co.uk`)."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*double_suffixes), F.substring_index(host, ".", -3)).otherwise(two) if double_suffixes else two


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule whose host is the url's or a parent of it, and whose path begins the url's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _level(units: DataFrame, m: Column) -> float:
    """Pages that the prior of this level would weigh, were its means `m` known. `units` have `n`, `bad`."""
    z = F.col("n") * F.pow(F.col("bad") / F.col("n") - m, F.lit(2)) / (m * (1 - m))
    found = units.where("n > 0").agg(F.sum(z).alias("z"), F.count("*").alias("k"), F.sum("n").alias("n")).first()
    more = (found.n or 0) - found.k
    rho = (found.z - found.k) / more if more > 0 else MOST_RHO
    rho = min(MOST_RHO, max(LEAST_RHO, rho))
    return (1 - rho) / rho


def _inside(m: Column) -> Column:
    return F.least(F.greatest(m, F.lit(1e-6)), F.lit(1 - 1e-6))


def reputations(hosts: DataFrame, max_bad_rate: float = MAX_BAD_RATE, deviations: float = DEVIATIONS, double_suffixes: Sequence[str] = ()) -> DataFrame:
    """host, n, bad, mean, lower, blocked for each row of `hosts` (host, n labelled pages, bad among them; n may be zero).

    Hosts must be distinct. A host without labels has its domain's rate. Without any label at all nothing is blocked.
    """
    hosts = stored(hosts.select("host", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("bad", F.lit(0)).cast("long").alias("bad"),
                                domain_of(F.col("host"), double_suffixes).alias("domain"), suffix_of(F.col("host")).alias("suffix")), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = stored(hosts.groupBy("suffix", "domain").agg(*sums), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(*sums), "suffixes")
    everything = suffixes.agg(*sums).first()
    labelled = float(everything.n or 0)
    overall = F.lit((everything.bad or 0) / labelled if labelled else 0.0)

    def placed(units: DataFrame, parents: DataFrame | None, on: list[str]) -> DataFrame:
        """`rate`, `evidence` (pages) and `weight` (of the prior) of each unit, from `rate` and `evidence` of its parent."""
        above = (units.join(parents.select(*on, F.col("rate").alias("prior"), F.col("evidence").alias("behind")), on) if parents is not None
                 else units.withColumn("prior", overall).withColumn("behind", F.lit(labelled)))
        above = above.withColumn("prior", _inside(F.col("prior")))
        known = _level(above, F.col("prior"))
        above = above.withColumn("weight", known * F.col("behind") / (known + F.col("behind")))
        whole = F.col("n") + F.col("weight")
        return (above.withColumn("rate", F.when(whole > 0, (F.col("bad") + F.col("weight") * F.col("prior")) / whole).otherwise(F.col("prior")))
                .withColumn("evidence", F.least(whole, F.lit(labelled))).drop("prior", "behind"))

    suffixes = placed(suffixes, None, [])
    domains = placed(domains, suffixes, ["suffix"])
    hosts = placed(hosts, domains, ["suffix", "domain"])
    mean = F.col("rate")
    spread = F.sqrt(mean * (1 - mean) / (F.col("n") + F.col("weight") + 1))
    return (hosts.withColumn("lower", mean - deviations * spread)
            .select("host", "n", "bad", mean.alias("mean"), "lower", (F.col("lower") > max_bad_rate).alias("blocked")))


def judged(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bad_rate: float = MAX_BAD_RATE,
           deviations: float = DEVIATIONS, double_suffixes: Sequence[str] = ()) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages` (page_id, url).

    `outcomes` (host, n, bad) are labelled pages counted by distinct host. NULL or broken urls have empty host and path, which are judged
    like any other host; repeated rows stay; an empty table gives no row; other columns are ignored. Below `double_suffixes` (such as `co.uk`) a registered
    domain has three labels. Only blocked hosts are joined with the pages.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.select("host", "n", "bad")
    hosts = parts.select("host").distinct().join(known, "host", "left")
    blocked = stored(reputations(hosts, max_bad_rate, deviations, double_suffixes).where("blocked").select("host", F.lit("block").alias("_reputation")), "blocked-hosts")
    if fits_broadcast(blocked):
        blocked = F.broadcast(blocked)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return (parts.join(blocked, "host", "left").withColumn("_rule", rule)
            .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "_reputation", F.lit("allow")).alias("verdict")))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, n, bad: pages whose path names a labelled document (`/en/825`); bad means of low quality or toxic.

    Pages are counted by host and document, labels by document before they meet, so no repeated key multiplies rows.
    """
    document = F.regexp_extract(path_of(F.col("url")), "^/[a-z]+/([0-9]{1,18})", 1)
    viewed = (pages.select(host_of(F.col("url")).alias("host"), F.when(document != "", document.cast("long")).alias("doc_id")).where("doc_id is not null")
              .groupBy("host", "doc_id").agg(F.count("*").alias("views")))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.coalesce("quality", "toxic").isNotNull(), 0)
    marked = labels.select("doc_id", bad.alias("bad")).where("bad is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    return (viewed.join(marked, "doc_id").groupBy("host")
            .agg(F.sum(F.col("views") * F.col("n")).alias("n"), F.sum(F.col("views") * F.col("bad")).alias("bad")))


def op6_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of `pages`, judged by the fixed rules, then by the labels of the documents that pages show."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages, page_outcomes(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _unit_sql(units: str) -> str:
    """Units with their prior mean `m` and the pages `e` behind it, as SQL: the rate, its evidence and the weight of the prior."""
    rho = f"least({MOST_RHO}, greatest({LEAST_RHO}, case when sum(n) - count(*) > 0 then (sum(n * pow(bad / n - m, 2) / (m * (1 - m))) - count(*)) / (sum(n) - count(*)) else {MOST_RHO} end))"
    return f"""(select *, case when n + w > 0 then (bad + w * m) / (n + w) else m end rate, least(n + w, total) evidence
        from (select u.*, known * e / (known + e) w from {units} u,
              (select (1 - rho) / rho known from (select {rho} rho from (select n::double n, bad::double bad, m from {units} where n > 0)))), (select total from overall))"""


SQL = f"""
with parts as (select page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') host,
                      coalesce(regexp_extract(url, '{URL}', 2), '') path from pages),
viewed as (select host, try_cast(regexp_extract(path, '^/[a-z]+/([0-9]{{1,18}})', 1) as bigint) doc_id from parts),
marked as (select doc_id, case when quality = 0 or toxic = 1 then 1 when coalesce(quality, toxic) is not null then 0 end bad from labels),
known as (select host, count(*) n, sum(bad) bad from viewed join marked using (doc_id) where bad is not null group by host),
hosts as (select host, coalesce(n, 0)::bigint n, coalesce(bad, 0)::bigint bad, array_to_string(string_split(host, '.')[-2:], '.') dom, string_split(host, '.')[-1] suf
          from (select distinct host from parts) left join known using (host)),
doms as (select suf, dom, sum(n)::bigint n, sum(bad)::bigint bad from hosts group by suf, dom),
sufs as (select suf, sum(n)::bigint n, sum(bad)::bigint bad from doms group by suf),
overall as (select coalesce(sum(bad) / nullif(sum(n), 0), 0) m, coalesce(sum(n), 0)::double total from sufs),
sufs2 as (select suf, n, bad, least(greatest(m, 1e-6), 1 - 1e-6) m, total e from sufs, overall),
suf_rates as {_unit_sql('sufs2')},
doms2 as (select d.dom, d.suf, d.n, d.bad, least(greatest(s.rate, 1e-6), 1 - 1e-6) m, s.evidence e from doms d join suf_rates s using (suf)),
dom_rates as {_unit_sql('doms2')},
hosts2 as (select h.host, h.n, h.bad, least(greatest(d.rate, 1e-6), 1 - 1e-6) m, d.evidence e from hosts h join dom_rates d using (suf, dom)),
blocked as (select host from {_unit_sql('hosts2')} where rate - {DEVIATIONS} * sqrt(rate * (1 - rate) / (n + w + 1)) > {MAX_BAD_RATE}),
rules(rule, rule_host, rule_path, rule_verdict) as (values {', '.join(f"('{h}{p}', '{h}', '{p}', '{v}')" for h, p, v in RULES)}),
ruled as (select parts.*, b.host is not null bad_host,
                 (select max_by({{'rule': rule, 'verdict': rule_verdict}}, length(rule)) from rules
                  where (parts.host = rule_host or ends_with(parts.host, '.' || rule_host)) and starts_with(path, rule_path)) r
          from parts left join blocked b on b.host = parts.host)
select page_id, host, path, r.rule as "rule", coalesce(r.verdict, case when bad_host then 'block' else 'allow' end) verdict from ruled
"""
