"""URL filter: pattern rules found through their rarest literal token.

Every rule names the literal tokens (runs of a-z and 0-9) that any URL it fits
must hold. The token of a rule that is rarest among the URLs at hand is its
index entry. A URL looks up its own tokens, and only the rules fetched that way
run their regular expression on it. An alternative is a rule of its own, so that
each has its token; a rule that still has none (the parameter allows it) sits
under the empty token, which every URL holds.

Distinct URLs are judged once (a URL that fills a third of the table costs one
row after the map-side aggregate) and the verdicts join back by URL. The rule
table is a parameter: a local relation whose size Spark knows, so it is
broadcast under ``spark.sql.autoBroadcastJoinThreshold`` and shuffled above it.
DataFrame functions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, local_rows, table


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host + everything up to ``#``; ``tokens`` must all occur in a URL it fits.

    Of several rules that fit a URL the one with the highest (``rank``,
    ``name``) decides.
    """
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = False       # a host and path rule, reported by name


def words_of(text: str) -> tuple[str, ...]:
    return tuple(t for t in re.split("[^a-z0-9]+", text.lower()) if t)


def host_rule(name: str, verdict: str) -> Rule:
    """``host/path`` for that host and its subdomains, paths starting with the rule's."""
    host, slash, path = name.partition("/")
    path = slash + path
    whole = path if path.endswith("/") else path[:path.rfind("/") + 1]   # a cut last word is no token
    tail = re.escape(path) if path else r"(?=[/?]|\z)"      # a query may follow the host at once
    return Rule(name, verdict, rf"\A(?:[^/?]*\.)?{re.escape(host)}{tail}", words_of(host) + words_of(whole),
                1000 + len(name), True)


#: The listed rules.
LISTED = (host_rule("net/", "block"), host_rule("example.net/en/", "allow"),
          host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow"))
#: Rules for URLs without a listed one: pages that hold no prose.
PATTERNS = (
    Rule("login page", "block", r"(?i)/login(?:[/?]|\z)", ("login",), 1),
    Rule("sign-in page", "block", r"(?i)/signin(?:[/?]|\z)", ("signin",), 1),
    Rule("blog login", "block", r"(?i)/wp-login\.php(?:[/?]|\z)", ("wp", "login", "php"), 1),
    Rule("PHP session", "block", r"(?i)[?&;]phpsessid=", ("phpsessid",), 2),
    Rule("Java session", "block", r"(?i)[?&;]jsessionid=", ("jsessionid",), 2),
    Rule("shopping cart", "block", r"(?i)/cart(?:[/?]|\z)", ("cart",), 3),
    Rule("checkout", "block", r"(?i)/checkout(?:[/?]|\z)", ("checkout",), 3),
    Rule("site search", "block", r"(?i)/search/?\?(?:.*&)?q=", ("search", "q"), 4),
    Rule("admin area", "block", r"(?i)/wp-admin/", ("wp", "admin"), 5),
    Rule("calendar trap", "block", r"(?i)/calendar/\d{4}/\d{1,2}/\d{1,2}", ("calendar",), 6),
)
DEFAULT_VERDICT = "allow"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, subject) of a URL; all empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    host = ascii_lower(raw)
    return host, F.regexp_extract(after, r"\A[^?#]*", 0), F.concat(host, F.regexp_extract(after, r"\A[^#]*", 0))


def _tokens(subject: Column) -> Column:
    """Distinct tokens of a URL, and the empty one."""
    return F.array_distinct(F.array_append(F.split(F.lower(subject), "[^a-z0-9]+"), F.lit("")))


def rule_index(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(token, rank_no, pattern): each rule under its rarest token among ``urls`` (column ``subject``)."""
    spark = urls.sparkSession
    ordered = sorted(rules, key=lambda r: (r.rank, r.name))
    wanted = local_rows(spark, [("token", "string"), ("rank_no", "int")],
                        [(t, i) for i, r in enumerate(ordered) for t in (set(r.tokens) or {""})])
    patterns = local_rows(spark, [("rank_no", "int"), ("pattern", "string")],
                          [(i, r.pattern) for i, r in enumerate(ordered)])
    seen = (urls.select(F.explode(_tokens(F.col("subject"))).alias("token"))
            .join(wanted.select("token").distinct(), "token").groupBy("token").count())
    rarest = (wanted.join(seen, "token", "left")
              .groupBy("rank_no").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("best")))
    return rarest.select("rank_no", F.col("best.token").alias("token")).join(patterns, "rank_no")


def fetched(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, subject, rank_no, pattern): the rules whose index token a URL holds, the only ones whose expressions run."""
    return urls.select("url", "subject", F.explode(_tokens(F.col("subject"))).alias("token")).join(index, "token").drop("token")


def judge(pages: DataFrame, rules: Sequence[Rule] = LISTED + PATTERNS, default: str = DEFAULT_VERDICT,
          url_col: str = "url") -> DataFrame:
    """All columns of ``pages`` plus host, path, rule, verdict, pattern_rule.

    ``rule`` names the listed rule that decided (else null), ``pattern_rule``
    the other rule that did. Null URLs and URLs without ``://`` have an empty
    host and path and fit no listed rule; repeated rows are judged alike;
    columns of ``pages`` with the names of the new ones are replaced; an empty
    table or no rules at all give the default verdict.
    """
    new = ["host", "path", "rule", "verdict", "pattern_rule"]
    url = F.col(f"`{url_col}`")
    host, path, subject = url_parts(url)
    urls = pages.select(url.alias("url")).dropna().distinct().select("url", subject.alias("subject"))
    index = rule_index(pages.select(subject.alias("subject")), rules)
    best = (fetched(urls, index).filter(F.regexp_like("subject", F.col("pattern")))
            .groupBy("url").agg(F.max("rank_no").alias("rank_no")))
    ordered = sorted(rules, key=lambda r: (r.rank, r.name))
    names = local_rows(pages.sparkSession, [("rank_no", "int"), ("name", "string"), ("decided", "string"), ("listed", "boolean")],
                       [(i, r.name, r.verdict, r.listed) for i, r in enumerate(ordered)])
    found = best.join(names, "rank_no").select(
        F.col("url").alias("_url"), F.when(F.col("listed"), F.col("name")).alias("_rule"),
        F.when(~F.col("listed"), F.col("name")).alias("_pattern"), F.col("decided").alias("_verdict"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in new]
    return pages.join(found, url == F.col("_url"), "left").select(
        *kept, host.alias("host"), path.alias("path"), F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.lit(default)).alias("verdict"), F.col("_pattern").alias("pattern_rule"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH a AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
b AS (SELECT page_id, CASE WHEN strpos(u, '://') > 0 THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM a),
c AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM b),
d AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
             regexp_extract(substr(rest, length(raw) + 1), '^[^#]*') AS tail FROM c),
e AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM d)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(host || tail, '(?i)/(login|signin|wp-login\.php)([/?]|$)')
    OR regexp_matches(host || tail, '(?i)[?&;](phpsessid|jsessionid)=')
    OR regexp_matches(host || tail, '(?i)/(cart|checkout)([/?]|$)')
    OR regexp_matches(host || tail, '(?i)/search/?\?(.*&)?q=')
    OR regexp_matches(host || tail, '(?i)/wp-admin/')
    OR regexp_matches(host || tail, '(?i)/calendar/\d{4}/\d{1,2}/\d{1,2}') THEN 'block'
  ELSE 'allow' END AS verdict
FROM e
"""

QUERIES = {"op5_url_rules": op5_url_rules}
ORACLES = {"op5_url_rules": ORACLE}
