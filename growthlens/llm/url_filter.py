"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a pattern: ``||`` anchors at a host label, ``*`` stands for anything, ``^`` for a separator or the end; the
rest is literal.  A rule's whole literal tokens (runs of a-z0-9 that no wildcard can lengthen) are counted over the
given URLs and the rarest becomes its index key.  A URL's tokens fetch candidate rules through an equi-join and only
those run their regular expressions.  Rules without a whole token have the empty key, which every URL carries.

Path rules (host suffix and path prefix) come first, the longest wins; without one the longest matching pattern rule
decides, an allowing one before a blocking one of the same length; without any the verdict is ``allow``.

Defined cases: a NULL url or one without ``://`` has an empty host and path and is allowed; repeated rows are kept; a
page_id may be NULL or repeated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


from .common import materialise, repeated

#: A token of the index is met in this many parts, so no token, and not the empty one either, is a hot key.
SALTS = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``name`` is reported for path rules, whose pattern is ``||`` + host + path."""

    name: str
    action: str
    pattern: str
    is_path: bool = False

    def regex(self) -> str:
        body = self.pattern
        anchored = body.startswith("||")
        body = body[2:] if anchored else body
        out = r"^(?:[^/?#]*\.)?" if anchored else ""
        for ch in body:
            out += ".*" if ch == "*" else r"(?:[^A-Za-z0-9_.%-]|$)" if ch == "^" else re.escape(ch)
        return out if self.is_path else "(?i)" + out

    def tokens(self) -> list[str]:
        """Literal tokens with a fixed separator (or the host anchor) on both sides."""
        body = self.pattern.lower()
        anchored = body.startswith("||")
        body = body[2:] if anchored else body
        found = []
        for m in re.finditer("[a-z0-9]+", body):
            left = body[m.start() - 1] != "*" if m.start() else anchored
            right = m.end() < len(body) and body[m.end()] != "*"
            if left and right:
                found.append(m[0])
        return sorted(set(found))


def path_rule(action: str, rule: str) -> Rule:
    return Rule(rule, action, "||" + rule, True)


#: Host and path rules of the registered query.
PATH_RULES = [path_rule("block", "net/"), path_rule("allow", "example.net/en/"),
              path_rule("block", "example.com/de/"), path_rule("allow", "org/fr/")]
#: Pattern rules for unwanted hosts and pages.
PATTERN_RULES = [Rule(p, a, p) for a, p in [
    ("block", "||spam-farm."), ("block", "||cheap-pills."), ("block", "||casino-win."), ("block", "||free-*-download."),
    ("block", "/popunder."), ("block", "/affiliate/*/click^"), ("block", "^clickid="), ("allow", "||gov^")]]


def url_parts(url: Column) -> dict[str, Column]:
    """host, path and the whole text after ``://`` with its host in lower case."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    tail = F.regexp_replace(rest, r"(?s)\A[^/?#]*", "")
    low = F.translate(host, _UPPER, _LOWER)
    return {"host": low, "path": F.regexp_extract(tail, r"(?s)\A[^?#]*", 0), "target": F.concat(low, tail)}


def url_tokens(target: Column) -> Column:
    """The distinct tokens of a URL and the empty key."""
    found = F.split(F.translate(target, _UPPER, _LOWER), "[^a-z0-9]+")
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.name, r.action, r.is_path, r.regex(), len(r.pattern), r.tokens()) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, rule string, action string, is_path boolean, regex string, "
                                       "length int, tokens array<string>")


def salted(df: DataFrame) -> DataFrame:
    """A row for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(SALTS)).cast("int")


def token_index(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """``rules`` with ``token``: their rarest literal token over ``targets``, or the empty key."""
    pairs = rules.select("rule_id", F.explode("tokens").alias("token"))
    used = targets.select(F.explode(url_tokens(F.col("target"))).alias("token"), salt(F.col("target")).alias("salt"))
    counts = used.join(salted(pairs.select("token").distinct()), ["token", "salt"]).groupBy("token").agg(
        F.count(F.lit(1)).alias("uses"))
    rarest = pairs.join(counts, "token", "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "token"))["token"].alias("token"))
    return rules.join(rarest, "rule_id", "left").withColumn("token", F.coalesce("token", F.lit(""))).drop("tokens")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, pattern (the deciding pattern rule) for every row of ``pages``."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = rule_table(spark, rules)
    parts = url_parts(F.col("url"))
    targets = pages.select("url").select(parts["target"].alias("target"))
    # written, so that its size is known: the planner sends a small index to the URLs, else both meet by token and salt
    index = materialise(salted(token_index(rules, targets)))
    rows = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.select("page_id", "url", "copies", *[c.alias(k) for k, c in parts.items()])
    keyed = rows.withColumn("token", F.explode(url_tokens(F.col("target")))).withColumn("salt", salt(F.col("target")))
    hits = keyed.join(index, (keyed["token"] == index["token"]) & (keyed["salt"] == index["salt"])
                      & F.rlike(keyed["target"], index["regex"]), "left")
    by_length = F.struct("length", F.col("action") == "allow", "action", "rule")
    best = hits.groupBy("page_id", "url").agg(
        F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(F.col("is_path"), by_length)).alias("fit"),
        F.max(F.when(~F.col("is_path"), by_length)).alias("pattern"))
    judged = best.select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                       F.coalesce("fit.action", "pattern.action", F.lit("allow")).alias("verdict"),
                       F.when(F.col("fit").isNull(), F.col("pattern.rule")).alias("pattern"), "copies")
    return repeated(judged, "copies")


#: The registered query in DuckDB's SQL.
SQL = r"""
with cut as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), named as (
  select page_id, coalesce(rest, '') as rest, regexp_extract(coalesce(rest, ''), '^[^/?#]*') as raw from cut
), parts as (
  select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         substr(rest, length(raw) + 1) as tail from named
), seen as (
  select page_id, host, regexp_extract(tail, '^[^?#]*') as path, host || tail as target,
         '.' || host as labels from parts
), fitted as (
  select *, case when ends_with(labels, '.example.net') and starts_with(path, '/en/') then 'example.net/en/'
                 when ends_with(labels, '.example.com') and starts_with(path, '/de/') then 'example.com/de/'
                 when ends_with(labels, '.org') and starts_with(path, '/fr/') then 'org/fr/'
                 when ends_with(labels, '.net') and starts_with(path, '/') then 'net/' end as rule from seen
), matched as (
  select *, (select max((length(p), a = 'allow', a, p)) from (values
      ('block', '||spam-farm.', '(?i)^(?:[^/?#]*\.)?spam-farm\.'),
      ('block', '||cheap-pills.', '(?i)^(?:[^/?#]*\.)?cheap-pills\.'),
      ('block', '||casino-win.', '(?i)^(?:[^/?#]*\.)?casino-win\.'),
      ('block', '||free-*-download.', '(?i)^(?:[^/?#]*\.)?free-.*-download\.'),
      ('block', '/popunder.', '(?i)/popunder\.'),
      ('block', '/affiliate/*/click^', '(?i)/affiliate/.*/click([^A-Za-z0-9_.%-]|$)'),
      ('block', '^clickid=', '(?i)([^A-Za-z0-9_.%-]|$)clickid='),
      ('allow', '||gov^', '(?i)^(?:[^/?#]*\.)?gov([^A-Za-z0-9_.%-]|$)')) r(a, p, x)
    where regexp_matches(target, x)) as best from fitted
)
select page_id, host, path, rule,
       case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
            else coalesce(best[3], 'allow') end as verdict,
       case when rule is null then best[4] end as pattern
from matched
"""
