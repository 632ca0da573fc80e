"""URL filter: host-and-path rules, then pattern rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyframe.llm.common import materialize, spread_join

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with the rule's.
SITE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Pattern rules on the lower-cased URL, blocking what they fit. ``||`` is the start of a host or of one of its
#: labels, ``^`` a separator (no letter, digit or one of ``%._-``) or the end, ``*`` anything; all else stands for itself.
#: A rule after ``@@`` is an exception: what it fits is allowed, whatever other pattern rules say.
PATTERN_RULES = (
    "||spam-farm.",
    "||cheap-pills.",
    "||free-casino.",
    "||casino.",
    "||adult-*.",
    "/wp-login.php^",
    "/xmlrpc.php^",
    "utm_source=spam^",
)


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.when(F.instr(url, "://") > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def _rest(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_regex(rule: str) -> str:
    """The regular expression of a pattern rule."""
    parts = {"||": r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", "^": r"([^a-z0-9%._-]|$)", "*": ".*"}
    return "".join(parts.get(x) or re.sub(r"([^a-z0-9])", r"\\\1", x) for x in re.findall(r"\|\||\^|\*|[^|^*]+|\|", rule.lower()))


def rule_tokens(rule: str) -> list[str]:
    """Literal runs of letters and digits that are whole tokens of every URL the rule fits.

    A run counts if a separator, a host's start or a character other than a letter or digit bounds it on both sides.
    """
    return [m[1] for m in re.finditer(r"(?:(?<=\|\|)|(?<=[^a-z0-9*|]))([a-z0-9]+)(?=[^a-z0-9*])", rule.lower())]


def url_tokens(url: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    site_rules: Sequence[tuple[str, str, str]] | DataFrame = SITE_RULES,
    pattern_rules: Sequence[str] | DataFrame = PATTERN_RULES,
) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``; input columns of these names are replaced.

    Site rules, tuples or a table (verdict, host, path), decide first: the longest host and path wins, of equally long ones the longer host,
    then the greater path, then block. Rules are filed under their hosts, and distinct hosts fetch those of their last labels. Other URLs are held against the
    pattern rules, texts or a table of one column: each rule is filed under the literal token that is rarest among all URLs' tokens, a URL's tokens
    fetch candidates, and only those run. Rules without a literal token run on every URL. A URL that a rule fits, and no exception does, is blocked. A null or
    empty URL has empty host and path, no rule, and is allowed. Repeated rows each get their verdict, very long URLs are looked at whole, and an
    empty table gives an empty one. Rules with a null, blank pattern rules and those that begin with ``!`` are left out. An index is broadcast if its bytes, summed up first, are few; else
    joins shuffle by salted keys.
    """
    spark: SparkSession = pages.sparkSession
    sites = site_rules if isinstance(site_rules, DataFrame) else spark.createDataFrame(list(site_rules), "verdict string, host string, path string")
    patterns = pattern_rules if isinstance(pattern_rules, DataFrame) else spark.createDataFrame([(p,) for p in pattern_rules], "rule string")
    u = F.col(url_col)
    base = pages.drop("host", "path", "rule", "verdict").withColumn("host", F.coalesce(url_host(u), F.lit(""))).withColumn("path", F.coalesce(url_path(u), F.lit("")))
    columns = base.columns
    index, size = site_index(base.select("host"), sites)
    best = F.get(F.filter("__site", lambda r: F.col("path").startswith(r["path"])), 0)
    base = spread_join(base, index, ["host"], "left", size=size).withColumns({"__url": u, "__best": best})
    # what is decided, and null URLs, need no join: as null keys they would all go to one task
    open_ = F.col("__best").isNull() & F.col("__url").isNotNull()
    hit = materialize(pattern_matches(base.where(open_).select("__url"), patterns), "url-hits")
    joined = spread_join(base.where(open_), hit, ["__url"], "left", size=_bytes(hit, "__url")).unionByName(base.where(~open_).withColumn("__hit", F.lit(False)))
    verdict = F.coalesce("__best.verdict", F.when(F.coalesce("__hit", F.lit(False)), "block").otherwise("allow"))
    return joined.select(*columns, F.col("__best.rule").alias("rule"), verdict.alias("verdict"))


def _bytes(table: DataFrame, *texts: str) -> int:
    """About how many bytes the rows of a table take, by the lengths of their texts."""
    return table.agg(F.sum(sum((F.octet_length(c) for c in texts), F.lit(64)))).first()[0] or 0


def site_index(hosts: DataFrame, rules: DataFrame) -> tuple[DataFrame, int]:
    """Hosts of ``hosts`` (one column) that site rules are written for, with ``__site``: these rules in the order in which they are tried; and the table's bytes.

    A host is looked up by as many of its last labels as a rule has at most, so that a host of very many labels costs no more.
    """
    parts = F.split("host", r"\.")
    known = rules.select("verdict", F.col("host").alias("of"), "path").dropna().distinct()
    depth = known.agg(F.max(F.size(F.split("of", r"\.")))).first()[0] or 0
    last = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    keys = hosts.select("host").distinct().select("host", F.explode(last if depth else F.array().cast("array<string>")).alias("of"))
    rule = F.concat("of", "path")
    order = F.struct(F.length(rule).alias("n"), F.length("of").alias("m"), "path", "verdict", rule.alias("rule"))
    found = spread_join(keys, known, ["of"], "inner", size=_bytes(known, "of", "path")).groupBy("host").agg(F.reverse(F.array_sort(F.collect_list(order))).alias("__site"))
    table = materialize(found, "url-sites")
    return table, table.agg(F.sum(64 + F.octet_length("host") + F.aggregate("__site", F.lit(0), lambda n, r: n + 80 + 2 * F.octet_length(r["rule"])))).first()[0] or 0


def compiled(rules: DataFrame) -> DataFrame:
    """Pattern rules (one column) with their regular expression, whether they are exceptions, and their tokens; the empty token if they have none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = [r.removeprefix("@@") for r in f.rule]
            yield pd.DataFrame({"pattern": [rule_regex(r) for r in own], "exception": f.rule.str.startswith("@@"), "tokens": [rule_tokens(r) or [""] for r in own]})

    kept = rules.toDF("rule").select(F.trim("rule").alias("rule")).where("rule <> '' and rule <> '@@' and not startswith(rule, '!')").distinct()
    return kept.mapInPandas(run, "pattern string, exception boolean, tokens array<string>")


def pattern_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``__url`` that a pattern rule fits and no exception does, with ``__hit`` true."""
    own = materialize(compiled(rules), "url-rules").withColumn("token", F.explode("tokens"))
    words = own.select("token").distinct()
    tokens = lambda found: found.select("__url", F.explode(F.array_append(url_tokens(F.col("__url")), "")).alias("token"))
    counts = spread_join(tokens(urls).select("token"), words, ["token"], "left_semi", size=_bytes(words, "token")).groupBy("token").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"]
    index = materialize(own.join(counts, "token", "left").groupBy("pattern", "exception").agg(rarest.alias("token")), "url-index")
    met = spread_join(tokens(urls.distinct()), index, ["token"], "inner", size=_bytes(index, "pattern", "token")).where(F.expr("rlike(lower(__url), pattern)"))
    return met.groupBy("__url").agg(F.max("exception").alias("allowed")).where("not allowed").select("__url", F.lit(True).alias("__hit"))
