"""URL rules found through their rarest literal token.

Every rule, a (host, path) pair or a pattern, becomes a regular expression over ``host + path`` plus the literal
tokens that any URL it fits must hold in full.  Only the rarest of these, by how many rules share it, indexes
the rule.  A URL's tokens fetch candidate rules in an equi-join and only those run their expression.  The
planner broadcasts the rule table where its size allows and else shuffles both sides, where adaptive
execution splits hot tokens.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import ascii_lower, table

#: A token is a run of ASCII letters and digits, lower-cased.
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """name is returned; weight orders rules of the same kind; host rules outrank patterns."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int


def host_rule(name: str, verdict: str) -> Rule:
    """``name`` is host and path prefix, like ``example.com/en/7``: it fits the host and all its subdomains."""
    host, _, path = name.partition("/")
    host, path = host.lower(), "/" + path
    whole = re.findall(TOKEN, host) + re.findall(TOKEN, path.lower())
    if re.search(r"[A-Za-z0-9]$", path):
        whole = whole[:-1]  # a prefix may end inside a token
    return Rule(name, verdict, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path), tuple(whole), 1_000_000 + len(name))


def pattern_rule(name: str, verdict: str, pattern: str, *tokens: str) -> Rule:
    """``tokens`` are the literals that every fitting URL holds as full tokens; matching ignores A-Z case."""
    return Rule(name, verdict, "(?i)" + pattern, tokens, len(name))


#: (host and path, verdict) of the contract, in its order.
HOST_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]

#: The method's own patterns, over host and path: trackers, advertisements, adult and gambling sites, log-in and cart pages.
PATTERNS = [
    ("ad-host", "block", r"^(?:[^/]*\.)?(?:ads|adserver|adservice)\.[^/]*/", ()),
    ("doubleclick", "block", r"^(?:[^/]*\.)?doubleclick\.(?:net|com)/", ("doubleclick",)),
    ("banner-path", "block", r"/banner/[^/]*\.(?:gif|swf|jpg)$", ("banner",)),
    ("pixel", "block", r"/pixel\.(?:gif|png)$", ("pixel",)),
    ("tracking", "block", r"/tracking/(?:click|open|impression)", ("tracking",)),
    ("casino", "block", r"^(?:[^/]*[.-])?casino[.-][^/]*/", ("casino",)),
    ("poker", "block", r"^(?:[^/]*[.-])?poker[.-][^/]*/", ("poker",)),
    ("porn", "block", r"^(?:[^/]*[.-])?porn[.-][^/]*/", ("porn",)),
    ("xxx-zone", "block", r"^[^/]*\.xxx/", ("xxx",)),
    ("login", "block", r"/login(?:\.php|\.aspx?|/)?$", ("login",)),
    ("signup", "block", r"/signup(?:\.php|\.aspx?|/)?$", ("signup",)),
    ("cart", "block", r"/cart/(?:add|checkout)", ("cart",)),
    ("wp-admin", "block", r"/wp-admin/", ("wp", "admin")),
    ("phpmyadmin", "block", r"/phpmyadmin/", ("phpmyadmin",)),
    ("calendar-trap", "block", r"/calendar/\d{4}/\d{1,2}/\d{1,2}/", ("calendar",)),
    ("replytocom", "block", r"/replytocom/", ("replytocom",)),
]


def production_rules() -> list[Rule]:
    fixed = [host_rule(*r) for r in HOST_RULES]
    return fixed + [pattern_rule(n, v, p, *t) for n, v, p, t in PATTERNS if t] + [pattern_rule(f"{n}:{t}", v, p, t) for n, v, p, ts in PATTERNS if not ts for t in ("ads", "adserver", "adservice")]


def index_rules(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(token, name, verdict, pattern, rank), one row a rule under its rarest token (ties: the longest, then the least)."""
    if bare := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token can't be indexed: {bare}")
    shared = Counter(t for r in rules for t in set(r.tokens))
    rows = [(min(r.tokens, key=lambda t: (shared[t], -len(t), t)), r.name, r.verdict, r.pattern, r.rank) for r in rules]
    kinds = {"token": pa.string(), "name": pa.string(), "verdict": pa.string(), "pattern": pa.string(), "rank": pa.int32()}
    # an Arrow table becomes a local relation, whose size the planner knows
    return spark.createDataFrame(pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(kinds.items())}))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract has them; both empty where the URL is null or has no ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(urls: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """(url, host, path, rule, rule_verdict, verdict, pattern_rule) for each distinct value of ``urls(url)``.

    Of the host rules that fit the longest wins and names ``rule``; else the pattern with the longest name
    gives ``verdict``, else ``default``.  Null and empty URLs are one row each, with empty host and path.
    """
    spark = urls.sparkSession
    host, path = url_parts(F.col("url"))
    one = urls.select("url").distinct().select("url", host.alias("host"), path.alias("path"))
    tokens = F.array_distinct(F.regexp_extract_all(ascii_lower(F.concat("host", "path")), F.lit(f"({TOKEN})"), 1))
    hits = (
        one.select("*", F.explode_outer(tokens).alias("token"))
        .join(index_rules(spark, rules), "token", "left")
        .select("url", "host", "path", F.when(F.expr("regexp(concat(host, path), pattern)"), F.struct("rank", "name", "verdict")).alias("hit"))
    )
    best = hits.groupBy("url", "host", "path").agg(F.max("hit").alias("hit"))
    fixed = F.col("hit.rank") >= 1_000_000
    return best.select("url", "host", "path", F.when(fixed, F.col("hit.name")).alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"), F.when(~fixed, F.col("hit.name")).alias("pattern_rule"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge_urls(pages, production_rules()).withColumnRenamed("url", "judged_url")
    return pages.join(judged, pages.url.eqNullSafe(judged.judged_url), "left").select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


def _oracle() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    fixed = " UNION ALL ".join(f"SELECT {lit(n)} AS name, {lit(v)} AS verdict, {lit(n.partition('/')[0])} AS rhost, {lit('/' + n.partition('/')[2])} AS rpath" for n, v in HOST_RULES)
    own = " ".join(f"WHEN regexp_matches(host || path, {lit(r.pattern)}) THEN {lit(r.name)}" for r in sorted(production_rules(), key=lambda r: (-r.rank, r.name), reverse=False) if r.rank < 1_000_000)
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
rules AS ({fixed}),
best AS (
  SELECT p.page_id, p.host, p.path, r.name, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.name) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath)),
own AS (SELECT *, CASE WHEN name IS NULL THEN CASE {own} ELSE NULL END END AS pattern_rule FROM best WHERE k = 1)
SELECT page_id, host, path, name AS rule, coalesce(verdict, CASE WHEN pattern_rule IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern_rule FROM own
"""


OP3_SQL = _oracle()
