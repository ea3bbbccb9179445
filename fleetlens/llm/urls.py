"""URL filters by rarest literal token (operator 2), DataFrame functions only.

A rule is a pattern over host and path.  Its literal tokens are the runs of
letters and digits that any fitting URL must hold as a whole run.  A count of the
rules' tokens over all URLs tells which token of each rule is the rarest; the rule
is filed under it.  A URL's tokens fetch candidate rules by an equi-join with that
index, and only those run their regular expression.  Rules without a literal token
are filed under the empty token, which every URL has.

The rule table is a parameter, so the index has at most one row per rule: it is
broadcast up to ``MAX_BROADCAST_RULES`` rules and joined by a shuffle beyond.

Edge cases: a null url, or one without ``://``, has empty host and path and fits no
host rule; repeated rows are judged once each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_RULES = 50_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``action`` for URLs that fit.

    A host rule names a host (with its subdomains) and a path prefix.  A pattern
    rule names text found anywhere in host and path, ``*`` standing for any text;
    it decides only where no host rule fits.
    """

    action: str
    host: str | None = None
    path: str = "/"
    pattern: str | None = None

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}" if self.host is not None else str(self.pattern)

    @property
    def regex(self) -> str:
        """Over host and path joined: a host holds no ``/`` and a path is empty or starts with one, so nothing is lost."""
        if self.host is not None:
            return rf"^([^/]*\.)?{_quoted(self.host)}{_quoted(self.path)}"
        return "(?s)" + ".*".join(_quoted(p) for p in str(self.pattern).split("*"))

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that are bounded on both sides inside the rule."""
        text = f".{self.host}{self.path}" if self.host is not None else str(self.pattern)
        found = re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", text.lower())
        return sorted(set(found))


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/ ])", r"\\\1", text)


#: The rules of the registered query.
HOST_RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

#: What blocks a URL that no host rule fits: words of link farms, as whole words of host or path.
PATTERN_RULES = tuple(Rule("block", pattern=p) for p in (".cheap-pills.", "/cheap-pills.", ".spam-farm.", "/spam-farm.", "-casino.", "-casino-", ".casino-", "/casino/", "/poker/", "/wp-login."))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct runs of letters and digits of a URL, and the empty token."""
    text = F.translate(F.concat(host, path), UPPER, LOWER)
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))))


def rule_table(spark, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(i, r.name, r.action, r.host is not None, r.regex, r.tokens or [""]) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_no int, rule string, action string, is_host boolean, regex string, tokens array<string>")


def rule_index(urls: DataFrame, rules: DataFrame, n_rules: int) -> DataFrame:
    """Each rule under the token of it that the fewest URLs hold (ties: the first in order)."""
    wanted = rules.select("rule_no", F.explode("tokens").alias("token"))
    distinct = wanted.select("token").distinct()
    held = urls.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).where("token <> ''")
    counts = held.join(F.broadcast(distinct) if n_rules <= MAX_BROADCAST_RULES else distinct, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(counts, "token", "left").groupBy("rule_no").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    return rarest.join(rules.drop("tokens"), "rule_no")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = HOST_RULES + PATTERN_RULES, url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule (of the longest fitting host rule) and verdict of every row.

    One shuffle: rows are widened to their candidate rules, reduced to the best per
    row before the exchange, and grouped by a row number.
    """
    base = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    index = rule_index(base.select("host", "path"), rule_table(pages.sparkSession, rules), len(rules))
    if len(rules) <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    numbered = base.withColumn("row_no", F.monotonically_increasing_id())
    asked = numbered.withColumn("token", F.explode(url_tokens(F.col("host"), F.col("path"))))
    fits = F.regexp_like(F.concat("host", "path"), F.col("regex")) & ~(F.col("is_host") & (F.col("host") == ""))
    # hosts before patterns, then the longest, then the first listed
    best = F.when(fits, F.struct(F.col("is_host"), F.length("rule").alias("n"), (-F.col("rule_no")).alias("order"), F.col("rule"), F.col("action")))
    judged = asked.join(index, "token", "left").withColumn("best", best)
    one = judged.groupBy("row_no").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return one.select("page_id", "host", "path", F.when(F.col("best.is_host"), F.col("best.rule")).alias("rule"), F.coalesce("best.action", F.lit("allow")).alias("verdict"))


ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), r AS (
  SELECT page_id, host, path, CASE
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host || path, '[./]cheap-pills\.|[./]spam-farm\.|-casino\.|-casino-|\.casino-|/casino/|/poker/|/wp-login\.') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
