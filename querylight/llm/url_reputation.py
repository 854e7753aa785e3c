"""URL filter: listed rules first, then the reputation of the host from labelled pages.

Outcomes (bad or not) of labelled pages are summed per host, registered domain and public suffix.
Each level's bad rate is shrunk towards the one above by a beta-binomial prior, whose strength comes
from how far the groups of the level scatter beyond binomial chance (method of moments): host to
registered domain, domain to suffix, suffix to all pages. A host is blocked when the lower bound of
its posterior bad rate lies above `threshold`; a host without outcomes has its domain's prior, so it
is blocked only if the domain's pages are bad beyond doubt.

Rules are a short list in code; the longest that fits decides. A rule fits its host and subdomains
when the url's path starts with the rule's path.

Results for odd input: a null url, or one without `://`, has host and path '', fits no rule, teaches
nothing and takes the prior over all pages. Pages without an outcome teach nothing. A host of digits
and dots only is its own domain. Without any outcome all rates are one half and nothing is blocked.
Repeated rows are pages each and keep their verdicts; urls of any length are cut by patterns that read
them once. Of rules that fit with equal length the first in order of host and path wins.
Host sums are made before any shuffle of pages, so a host with a third of the pages is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querylight.llm.common import lower_az, small
from querylight.llm.registry import query, table
from querylight.session import stage

# (host, path, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Public suffixes of two labels, by country. Where a caller's table names none, the suffix is the last label.
SECOND_LEVEL = {
    "ar": "com edu gob net org",
    "au": "asn com edu gov id net org",
    "br": "com edu gov net org",
    "cn": "ac com edu gov net org",
    "hk": "com edu gov net org",
    "id": "ac co go or web",
    "il": "ac co gov net org",
    "in": "ac co edu gov net org",
    "jp": "ac co ed go ne or",
    "kr": "ac co go ne or re",
    "mx": "com edu gob net org",
    "my": "com edu gov net org",
    "nz": "ac co govt net org school",
    "sg": "com edu gov net org",
    "th": "ac co go in or",
    "tr": "com edu gov net org",
    "tw": "com edu gov net org",
    "uk": "ac co gov ltd me net nhs org plc police sch",
    "za": "ac co gov net org web",
}
THRESHOLD = 0.35
Z = 1.645  # the lower bound leaves one twentieth below


def host_of(url: Column) -> Column:
    """From behind the first `://` to the next `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.when(url.contains("://"), lower_az(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    kind = "struct<rule:string,verdict:string>"
    found = F.when(F.lit(False), F.lit(None).cast(kind))
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = found.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")))
    return found.otherwise(F.lit(None).cast(kind))


def known_suffixes(spark: SparkSession) -> DataFrame:
    """`suffix` rows of `SECOND_LEVEL`."""
    names = " ".join(f"{label}.{country}" for country, labels in SECOND_LEVEL.items() for label in labels.split())
    return spark.range(1).select(F.explode(F.split(F.lit(names), " ")).alias("suffix"))


def with_domain(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Adds domain and suffix of `host`, without user and port: the longest of `suffixes` (suffix) that the host
    ends with, label by label, else its last label; the domain has one label more."""
    listed = stage(suffixes.filter("suffix is not null").select("suffix").distinct(), "listed")
    labels = F.size(F.split("suffix", r"\."))
    rows, deepest = listed.agg(F.count("*"), F.coalesce(F.max(labels), F.lit(1))).first()
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    found = hosts.withColumn("_bare", bare)
    for n in range(2, deepest + 1):
        of_length = listed.filter(labels == n).select(F.col("suffix").alias(f"_s{n}"))
        tail = F.substring_index("_bare", ".", -n)
        found = found.join(small(of_length, rows, 256), tail == F.col(f"_s{n}"), "left")
    longest = F.coalesce(*[F.col(f"_s{n}") for n in range(deepest, 1, -1)], F.substring_index("_bare", ".", -1))
    found = found.withColumn("_suffix", longest)
    # A label before the suffix, if there is one.
    label = F.substring_index(F.expr("left(_bare, greatest(length(_bare) - length(_suffix) - 1, 0))"), ".", -1)
    domain = F.when(F.length("_bare") > F.length("_suffix") + 1, F.concat(label, F.lit("."), "_suffix")).otherwise(F.col("_bare"))
    numeric = F.col("_bare").rlike(r"^[0-9.]*$")
    return found.select(
        *hosts.columns,
        F.when(numeric, F.col("_bare")).otherwise(domain).alias("domain"),
        F.when(numeric, F.lit("")).otherwise(F.col("_suffix")).alias("suffix"),
    )


def strength(groups: DataFrame) -> float:
    """Prior strength from groups (n, bad, prior): the fewer they scatter beyond chance, the stronger."""
    chance = F.col("prior") * (1 - F.col("prior"))
    row = groups.agg(
        F.sum((F.col("bad") - F.col("n") * F.col("prior")) ** 2).alias("scatter"),
        F.sum(F.col("n") * chance).alias("expected"),
        F.sum(F.col("n") * (F.col("n") - 1) * chance).alias("pairs"),
    ).first()
    rho = ((row["scatter"] or 0) - (row["expected"] or 0)) / row["pairs"] if row["pairs"] else 0.0
    return 1 / min(max(rho, 1e-4), 0.99) - 1


def reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, rate, bound) per host of `outcomes` (host, bad: 1, 0 or null). `suffixes` (suffix) lists public
    suffixes of two and more labels, a table of any size; without it those of `SECOND_LEVEL` count."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    listed = known_suffixes(outcomes.sparkSession) if suffixes is None else suffixes
    hosts = stage(with_domain(hosts, listed), "hosts")
    named = hosts.filter("host <> ''")
    total = named.agg(F.sum("n"), F.sum("bad")).first()
    overall = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = named.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(overall))
    k = strength(suffixes)
    suffixes = suffixes.select("suffix", ((F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).alias("prior"))
    suffixes = stage(suffixes, "suffixes")
    domains = named.groupBy("domain", "suffix").agg(*sums).join(suffixes, "suffix")
    k = strength(domains)
    domains = domains.select("domain", ((F.col("bad") + k * F.col("prior")) / (F.col("n") + k)).alias("prior"))
    domains = stage(domains, "domains")
    own = hosts.join(domains, "domain", "left").withColumn("prior", F.coalesce("prior", F.lit(overall)))
    k = strength(own.filter("host <> ''"))
    a, size = F.col("bad") + k * F.col("prior"), F.col("n") + F.lit(k)
    rated = own.select("host", "n", "bad", (a / size).alias("rate"), size.alias("size"))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("size") + 1))
    return rated.select("host", "n", "bad", "rate", F.greatest(F.col("rate") - Z * spread, F.lit(0.0)).alias("bound"))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    url_col: str = "url",
    rules: list[tuple[str, str, str]] | None = None,
    threshold: float = THRESHOLD,
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """`pages` with host, path, rule, verdict (replaced where there). `outcomes` (host, bad) covers every host of `pages`,
    `suffixes` are those of `reputation`."""
    added = ["host", "path", "rule", "verdict"]
    keep = [c for c in pages.columns if c not in added or c == url_col]
    url = F.coalesce(F.col(url_col), F.lit(""))
    rated = stage(reputation(outcomes, suffixes).select(F.col("host").alias("rated_host"), "bound"), "reputation")
    # The caller's columns travel as one, so that none of their names meets another.
    parts = pages.select(F.struct(*keep).alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    parts = parts.withColumn("fit", matched_rule(F.col("host"), F.col("path"), RULES if rules is None else rules))
    joined = parts.join(small(rated, rated.count(), 256), F.col("host") == F.col("rated_host"), "left")
    own = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in keep],
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), own).alias("verdict"),
    )


ORACLE = f"""
with p as (
  select page_id, url,
    case when url like '%://%' then translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when url like '%://%' then regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') else '' end as path
  from pages),
l as (
  select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad
  from labels where quality is not null or toxic is not null group by doc_id),
o as (select host, bad from p left join l on try_cast(nullif(regexp_extract(path, '^/[a-z]+/([0-9]+)', 1), '') as bigint) = l.doc_id),
bare as (select host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as b, count(bad) as n, coalesce(sum(bad), 0) as bad from o group by host),
h as (
  select host, n, bad,
    case when regexp_full_match(b, '[0-9.]*') then b else array_to_string(list_slice(string_split(b, '.'), -2, -1), '.') end as domain,
    case when regexp_full_match(b, '[0-9.]*') then '' else string_split(b, '.')[-1] end as suffix
  from bare),
hn as (select * from h where host <> ''),
g as (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) as prior from hn),
s0 as (select suffix, sum(n) as n, sum(bad) as bad, any_value(g.prior) as prior from hn, g group by suffix),
ks as (select 1 / least(greatest(coalesce((sum((bad - n * prior) ** 2) - sum(n * prior * (1 - prior))) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0), 1e-4), 0.99) - 1 as k from s0),
s1 as (select suffix, (bad + k * prior) / (n + k) as prior from s0, ks),
d0 as (select domain, suffix, sum(n) as n, sum(bad) as bad, any_value(s1.prior) as prior from hn join s1 using (suffix) group by domain, suffix),
kd as (select 1 / least(greatest(coalesce((sum((bad - n * prior) ** 2) - sum(n * prior * (1 - prior))) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0), 1e-4), 0.99) - 1 as k from d0),
d1 as (select domain, (bad + k * prior) / (n + k) as prior from d0, kd),
h0 as (select h.host, h.n, h.bad, coalesce(d1.prior, g.prior) as prior from h left join d1 using (domain), g),
kh as (select 1 / least(greatest(coalesce((sum((bad - n * prior) ** 2) - sum(n * prior * (1 - prior))) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0), 0), 1e-4), 0.99) - 1 as k from h0 where host <> ''),
h1 as (select host, (bad + k * prior) / (n + k) as rate, n + k as size from h0, kh),
h2 as (select host, rate - {Z} * sqrt(rate * (1 - rate) / (size + 1)) as bound from h1),
r(rule_host, rule_path, v) as (values {", ".join(str(r) for r in RULES)}),
fits as (
  select page_id, host, path, rule_host || rule_path as rule, v,
    row_number() over (partition by page_id order by length(rule_host || rule_path) desc) as place
  from p join r on (p.host = rule_host or p.host like '%.' || rule_host) and starts_with(p.path, rule_path))
select p.page_id, p.host, p.path, f.rule, coalesce(f.v, case when h2.bound > {THRESHOLD} then 'block' else 'allow' end) as verdict
from p left join fits f on f.page_id = p.page_id and f.place = 1 left join h2 on h2.host = p.host
"""


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) per page: bad when the document named by the url's path is labelled toxic or of no quality."""
    judged = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("doc"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    judged = judged.agg(F.max(F.when(bad, 1).otherwise(0)).alias("bad"))
    url = F.coalesce(F.col("url"), F.lit(""))
    named = pages.select(host_of(url).alias("host"), path_of(url).alias("path"))
    doc = F.regexp_extract("path", "^/[a-z]+/([0-9]+)", 1).try_cast("bigint")
    return named.select("host", doc.alias("doc")).join(judged, "doc", "left").select("host", "bad")


@query("op3_url_reputation", ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels"))).select(
        "page_id", "host", "path", "rule", "verdict"
    )
