"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over ``host + path`` (and query) with the literal tokens
that any matching URL must contain. Rarity is a token's frequency over all pages; a rule is
filed under its rarest token. A URL's distinct tokens fetch the rules filed under them, and
only those run their regular expression. Rules without a literal token are filed under the
empty token, which every URL has.

Two rule kinds share the index: site rules (host and its subdomains, path prefix; the
longest fitting one decides) and patterns (a match blocks a URL that no site rule decides).
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_RULES = 100_000

#: What separates tokens in a lower-cased URL.
TOKEN_SPLIT = r"[^0-9a-z]+"


class Rule(NamedTuple):
    rule: str  # as shown in the result
    regex: str  # over host || path || rest, host lower-cased
    tokens: tuple[str, ...]  # literal tokens of every match, lower case
    allow: bool
    rank: int  # length of a site rule; 0 for patterns


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """``host``/``path``: fits the host and its subdomains if the path starts with the rule's."""
    text = f"{host}/{path}"
    whole = re.findall(r"[0-9a-z]+(?=[^0-9a-z])", text.lower())  # a token cut by the prefix's end is not literal
    return Rule(text, "^([^/?#]*[.])?" + re.escape(text), tuple(whole), verdict == "allow", len(text))


# The base rules.
SITE_RULES = (
    site_rule("allow", "org", ""),
    site_rule("block", "example.org", "es/"),
    site_rule("block", "example.org", "en/1"),
    site_rule("allow", "com", "fr/"),
    site_rule("block", "com", "de/"),
)

# Patterns of its own: tracking and feed parameters, advertising and adult hosts, archives.
PATTERNS = (
    Rule("tracking", r"[?&]utm_source=", ("utm", "source"), False, 0),
    Rule("paging", r"[?&]page=[0-9]+&ref=", ("page", "ref"), False, 0),
    Rule("ads", r"^(ads?|banner|doubleclick)[0-9]*[.]", (), False, 0),
    Rule("casino", r"[./-]casino[./-]", ("casino",), False, 0),
    Rule("adult", r"[./-]xxx[./-]", ("xxx",), False, 0),
    Rule("login", r"/login([/?#]|$)", ("login",), False, 0),
    Rule("archive", r"[.](zip|exe|tar|gz)([?#]|$)", (), False, 0),
)


def parts(url_col: str = "url"):
    """host (A-Z lower-cased) and path of a URL, both empty without ``://``, and all that
    follows the host."""
    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)://(.*)", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    after = F.regexp_replace(rest, r"^[^/?#]*", "")
    return host, F.regexp_extract(after, r"^[^?#]*", 0), after


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = SITE_RULES + PATTERNS) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (the deciding site rule, else
    null), pattern (the first matching pattern, by name, of an otherwise undecided URL),
    verdict (allow or block; allow without any match).

    A null URL or one without ``://`` has empty host and path and fits nothing: allow. URLs
    are judged once per distinct URL, so repeated rows share one verdict and hot URLs cost
    one look-up; nulls are matched null-safe. Extra columns are not read."""
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    host, path, after = parts("url")
    urls = p.select("url").distinct().withColumns({"host": host, "path": path, "subject": F.concat(host, after)})
    tokens = F.array_append(F.array_distinct(F.filter(F.split(F.lower("subject"), TOKEN_SPLIT), lambda t: t != "")), F.lit(""))
    seen = urls.select("host", "path", "url", "subject", tokens.alias("tokens"))
    table = spark.createDataFrame(
        [(n, r.rule, r.regex, list(r.tokens) or [""], r.allow, r.rank) for n, r in enumerate(rules)],
        "nth int, rule string, regex string, tokens array<string>, allow boolean, rank int")
    wanted = sorted({t for r in rules for t in r.tokens})
    count = seen.select(F.explode(F.array_intersect("tokens", F.array(F.lit(""), *map(F.lit, wanted)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    frequency = {r.token: r.df for r in count.toLocalIterator()}  # one row per rule token
    known = spark.createDataFrame([(t, frequency.get(t, 0)) for t in ["", *wanted]], "token string, df long")
    # file each rule under its rarest token
    filed = table.withColumn("token", F.explode("tokens")).join(known, "token")
    filed = filed.groupBy("nth").agg(
        F.min_by("token", F.struct("df", "token")).alias("token"), *[F.any_value(c).alias(c) for c in ("rule", "regex", "allow", "rank")])
    if len(rules) <= MAX_BROADCAST_RULES:
        filed = F.broadcast(filed)
    fetched = seen.withColumn("token", F.explode("tokens")).join(filed, "token")
    matched = fetched.where(F.expr("rlike(subject, regex)"))
    best = matched.groupBy("url").agg(
        F.max(F.when(F.col("rank") > 0, F.struct("rank", "rule", "allow"))).alias("site"),
        F.min(F.when(F.col("rank") == 0, F.struct("rule", "allow"))).alias("pattern"))
    best = best.withColumnRenamed("url", "b_url")
    out = p.join(best, F.col("url") == F.col("b_url"), "left")
    allowed = F.coalesce(F.col("site.allow"), F.col("pattern.allow"), F.lit(True))
    return out.select(
        F.col("id").alias(id_col), host.alias("host"), path.alias("path"), F.col("site.rule").alias("rule"),
        F.when(F.col("site").isNull(), F.col("pattern.rule")).alias("pattern"),
        F.when(allowed, "allow").otherwise("block").alias("verdict"))
