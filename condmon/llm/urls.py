"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path`` with the literal tokens
that any match must contain.  Token frequencies are counted over all urls of the
table; a rule is filed under its rarest token.  A url's tokens fetch candidate
rules from the index, a literal map in the plan, and only those candidates run
their expression.  Rules that have no literal token are candidates of every url.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from condmon.llm.common import without


@dataclass(frozen=True)
class Rule:
    """``name`` as reported, ``verdict`` allow or block; ``host`` fits itself and its subdomains, ``path`` is a prefix."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Over the url's host and path on end: a host has no slash and a path starts with one, so the seam is certain."""
        return r"^(?:[^/]*\.)?" + re.escape(self.host) + (re.escape(self.path) or "(?:/|$)")

    def tokens(self) -> list[str]:
        """Tokens that any fitting url has: whole runs of A-Z, a-z and 0-9.  The rule's path may end within a run of the url, so its last run counts only before a separator.  There may be none."""
        path = re.findall(r"(?<![A-Za-z0-9])[A-Za-z0-9]+(?![A-Za-z0-9]|\Z)", self.path)
        return list(dict.fromkeys(re.findall("[A-Za-z0-9]+", self.host) + path))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for a null or without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct whole runs of A-Z, a-z and 0-9."""
    runs = F.split(F.concat_ws(" ", host, path), "[^A-Za-z0-9]+")
    return F.array_distinct(F.filter(runs, lambda t: t != ""))


def judge(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (name of the longest fitting rule, else null) and ``verdict`` (its verdict, else ``default``).

    Null urls and urls without ``://`` have empty host and path and fit no
    rule.  Of equally long rules the first in byte order of names wins.  The
    rules are a driver-side list that goes into the plan (bounded by what a person
    writes, some thousands); one row of
    the input gives one row, repeated rows are judged alike, and columns named
    like an output are replaced.
    """
    clean = without(df, ["host", "path", "rule", "verdict"])
    parts = clean.withColumn("host", host_of(F.col(f"`{url_col}`"))).withColumn("path", path_of(F.col(f"`{url_col}`")))
    if not rules:
        return parts.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    literals = sorted({t for r in rules for t in r.tokens()}) or [""]
    seen = parts.select(F.explode(F.array_intersect(tokens_of(F.col("host"), F.col("path")), F.array(*map(F.lit, literals)))).alias("t"))
    counts = {r["t"]: r["n"] for r in seen.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # as many rows as the rules have tokens
    index: dict[str, list[Rule]] = {}
    for rule in rules:
        index.setdefault(min(rule.tokens(), key=lambda t: (counts.get(t, 0), t), default=""), []).append(rule)
    keys = F.array(*map(F.lit, sorted(index)))
    fetched = F.flatten(F.transform(F.array_intersect(F.concat(F.array(F.lit("")), tokens_of(F.col("host"), F.col("path"))), keys), lambda t: F.element_at(_table(index), t)))
    text = F.concat(F.col("host"), F.col("path"))
    fits = F.filter(F.col("__candidates"), lambda c: F.regexp_like(text, c["pattern"]))
    best = F.element_at(F.array_sort(F.transform(fits, lambda c: F.struct((-F.octet_length(c["name"])).alias("long"), c["name"].alias("name"), c["verdict"].alias("verdict")))), 1)
    found = parts.withColumn("__candidates", fetched).withColumn("__best", F.when(F.size(fits) > 0, best))
    return found.withColumn("rule", F.col("__best.name")).withColumn("verdict", F.coalesce(F.col("__best.verdict"), F.lit(default))).drop("__candidates", "__best")


def _table(index: dict[str, list[Rule]]) -> Column:
    """The index as a literal map from token to rules."""
    entry = lambda r: F.struct(F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), F.lit(r.verdict).alias("verdict"))
    return F.create_map(*[x for t, rules in sorted(index.items()) for x in (F.lit(t), F.array(*map(entry, rules)))])
