"""URL filters in DataFrame functions only.

Each URL is expanded into host suffixes (whole labels) times path prefixes (of the lengths
that rules have); the expressions' short digest prefixes are equi-joined to the rules', full
digests confirm, and the longest rule wins.  Distinct URLs are judged once; what was found joins
the rows by URL, URLs of more than a thousandth of the rows (at most 1000) by broadcast, so that no task gets
all rows of one.  Rows without a URL meet nobody.  Rules are broadcast only while they are few.

The host runs from after the first :// to the first /, ?, # or the end, A-Z lower-cased; the
path from there to ?, # or the end.  Null URLs and URLs without :// have an empty host and
path, which no rule fits.  A URL without a fitting rule gets `default`.  Of rules of one
length the longer host wins, then allow.  Repeated rows are judged alike; an empty table
gives an empty result; repeated rules count once; other columns are carried by `filter_urls`,
whatever their names, but for ones named like its results (in any case), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import cut, spread_join

#: The rules of the contract: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to which they are broadcast (each is under 2 kB); more are joined by shuffle.
BROADCAST_RULES = 20_000
SHORT = 8  # hex digits of a digest in the first join


def rules_table(spark, rules=RULES) -> DataFrame:
    rows = F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(("rule_host", "rule_path", "rule_verdict"), r, strict=True))) for r in rules))
    return spark.range(1).select(F.inline(rows))


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """The host (A-Z lower-cased) and the path of a URL, '' where there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict."""
    spark = pages.sparkSession
    rules = rules_table(spark) if rules is None else rules
    rules = rules.distinct().withColumn("rule_expr", F.concat("rule_host", "rule_path")).withColumn("rule_digest", F.sha2("rule_expr", 256))
    rules = rules.withColumn("short", F.substring("rule_digest", 1, SHORT))
    lengths = [r[0] for r in rules.select(F.length("rule_path").alias("n")).distinct().orderBy("n").collect()]
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    # all columns go through as one, so that their names meet none of the operator's
    rows = pages.select(F.col("url").cast("string").alias("url"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept))).alias("rest"))
    host, path = host_and_path(F.col("url"))
    urls = cut(rows.where("url is not null").groupBy("url").agg(F.count("*").alias("n")))
    labels = urls.select("url", host.alias("host"), path.alias("path")).where("host <> ''").withColumn("labels", F.split("host", r"\."))
    suffix = F.explode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))"))
    prefix = F.explode(F.expr(f"transform(filter(array({', '.join(map(str, lengths)) or 'cast(null as int)'}), n -> n <= length(path)), n -> substring(path, 1, n))"))
    forms = labels.select("url", "path", suffix.alias("suffix")).select("url", "suffix", prefix.alias("prefix"))
    forms = forms.withColumn("digest", F.sha2(F.concat("suffix", "prefix"), 256)).withColumn("short", F.substring("digest", 1, SHORT))
    side = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    # a digest names host and path together; their border is confirmed as well
    hits = forms.join(side, "short").where("digest = rule_digest and suffix = rule_host")
    rank = F.struct(F.length("rule_expr").alias("all"), F.length("rule_host").alias("host"), (F.col("rule_verdict") == "allow").alias("allow"), F.col("rule_expr").alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = urls.join(hits.groupBy("url").agg(F.max(rank).alias("best")), "url", "left").select("url", "n", "best.rule", "best.verdict")
    judged = spread_join(rows.where("url is not null"), best, ["url"], "n")
    without = rows.where("url is null").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    out = judged.unionByName(without)
    return out.select(*(F.col(f"rest.c{i}").alias(c) for i, c in enumerate(kept)), host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
