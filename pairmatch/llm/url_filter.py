"""URL rules found by their rarest literal token; only the rules found run their expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmatch.operators.joins import hot_keys, lookup_join, salted_join
from pairmatch.session import written


@dataclass(frozen=True)
class Rule:
    """A host and the start of a path, written ``host/path``; ``*`` stands for any characters.

    The rule fits its host and all subdomains. ``rank`` decides between rules that fit: the
    higher one wins, then the longer text, then the smaller.
    """

    text: str
    verdict: str
    rank: int = 0

    def expression(self) -> str:
        """The rule as a regular expression over host and path."""
        body = ".*".join(re.escape(part) for part in self.text.split("*"))
        return rf"(?s)^(?:[^/]*\.)?{body}"

    def tokens(self) -> list[str]:
        """Tokens that every URL the rule fits has: those between literal delimiters.

        A token at the end or next to ``*`` may be a part of a longer one and does not count.
        The host starts a token, since a dot or the start of the URL stands before it.
        """
        found = re.finditer(r"[A-Za-z0-9]+", self.text)
        whole = [
            m[0] for m in found
            if self.text[m.end() : m.end() + 1] not in ("", "*")
            and (m.start() == 0 or self.text[m.start() - 1] != "*")
        ]
        return sorted(set(whole))


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty without ``://`` and for a null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    no_query = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1)
    host = F.substring_index(no_query, "/", 1)
    path = F.substring(no_query, F.length(host) + 1, F.length(no_query))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    empty = F.lit("")
    return F.coalesce(F.translate(host, upper, lower), empty), F.coalesce(path, empty)


def url_tokens(url: Column) -> Column:
    """Distinct runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(url, F.lit("([A-Za-z0-9]+)"), 1))


def rule_index(spark: SparkSession, rules: list[Rule], seen: DataFrame) -> DataFrame:
    """``(token, verdict, rule, expression, ...)``: every rule under its rarest token.

    ``seen`` has the number ``n`` of URLs per token. A rule without a token of its own gets a
    null token.
    """
    rows = [
        (r.text, r.verdict, r.rank, len(r.text), r.expression(), r.tokens() or [None])
        for r in rules
    ]
    table = spark.createDataFrame(
        rows,
        "rule string, verdict string, rank int, length int, expression string, tokens array<string>",
    )
    rest = ["rule", "verdict", "rank", "length", "expression"]
    counted = table.select(*rest, F.explode("tokens").alias("token")).join(seen, "token", "left")
    rarest = F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token"))
    return counted.groupBy(*rest).agg(rarest.alias("token"))


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """The verdict on every URL: ``(page_id, host, path, rule, verdict)``, a row per row.

    The tokens of the URLs are counted; each rule is filed under the one of its literal tokens
    that the fewest URLs have. A URL fetches the rules filed under its tokens and runs the
    expressions of these alone; rules without a whole literal token are run on every URL. Where
    no rule fits, ``rule`` is null and ``verdict`` is ``default``.

    Verdicts are made once per distinct URL that a rule fits and joined back by URL, so a URL
    that many pages share is salted. A null URL or one without ``://`` has an empty host and
    path and fits no rule. Other columns are not looked at. An empty table gives an empty
    result.
    """
    host, path = parse_url(F.col("url"))
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    parsed = named.select("page_id", host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    parsed = written(parsed.withColumn("target", F.nullif(target, F.lit(""))), "urls")
    targets = written(parsed.groupBy("target").agg(F.count("*").alias("n")), "targets")
    known = targets.where(F.col("target").isNotNull())
    words = known.select("target", F.explode(url_tokens(F.col("target"))).alias("token"))
    wanted = sorted({token for rule in rules for token in rule.tokens()})
    seen = words.where(F.col("token").isin(wanted)).groupBy("token").agg(F.count("*").alias("n"))
    index = written(rule_index(pages.sparkSession, rules, seen), "rules")
    fetched = lookup_join(words, index.where("token is not null"), ["token"], seen, F.col("target"))
    columns = ["target", "rule", "verdict", "rank", "length", "expression"]
    everywhere = [
        known.select(
            "target", F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"),
            F.lit(r.rank).alias("rank"), F.lit(len(r.text)).alias("length"),
            F.lit(r.expression()).alias("expression"),
        )
        for r in rules
        if not r.tokens()
    ]
    candidates = fetched.select(*columns)
    for rows in everywhere:
        candidates = candidates.unionByName(rows)
    first = F.max_by(
        F.struct("rule", "verdict"), F.struct("rank", "length", F.col("rule"))
    )
    judged = (
        candidates.where(F.regexp_like("target", F.col("expression")))
        .groupBy("target")
        .agg(first.alias("found"))
    )
    judged = judged.select("target", "found.rule", "found.verdict")
    back = salted_join(
        parsed, judged, ["target"], hot_keys(known, ["target"]), F.col("page_id"), how="left"
    )
    return back.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
