"""URL filters: host-and-path rules, then pattern rules found through their rarest literal token. DataFrame functions only.

Host rules: a rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the
longest fitting rule decides. Pattern rules decide the urls that no host rule fits. Each pattern rule has a
regular expression and the literal tokens that every url it matches must contain; it is indexed by the one of
them that fewest urls of the table contain. A url's distinct tokens fetch candidate rules by an equi-join, and
only those run their regular expression, once for each distinct url. A matching allow pattern outweighs block patterns; no match allows.

Scale: only id and url are read. Token counts are restricted to tokens of rules before they are aggregated, so
their table is no larger than the rule set. The rule index is broadcast while it has at most `broadcast_rules`
rows; beyond that it is an ordinary join. Candidates are matched in place, keyed by row, so the one shuffle
carries ids of urls with a matching rule only.

Defined results: null url or one without `://` has empty host and path and is allowed unless a pattern matches
(a null url never matches); urls of any length are judged whole; of fitting rules of one length the
greatest (verdict, host, path) decides; repeated rows get the same verdict each; rows with a null id are judged too; an empty table gives no rows; only id and
url are read, whatever the names of other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diskloom.llm.common import materialize, spread_join

#: (verdict, host, path)
HOST_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: (verdict, regular expression over the lower-cased url, tokens of [a-z0-9]+ that a match contains as whole tokens; a|b: one of them at least)
PATTERN_RULES = [
    ("block", r"://([^/?#]*\.)?spam-farm\.", ["spam", "farm"]),
    ("block", r"://([^/?#]*\.)?cheap-pills\.", ["cheap", "pills"]),
    ("block", r"://([^/?#]*\.)?adult-x\.", ["adult", "x"]),
    ("block", r"://([^/?#]*\.)?casino-[a-z0-9-]+\.", ["casino"]),
    ("block", r"[?&]utm_source=(ads|banner)(&|#|$)", ["utm", "source"]),
    ("block", r"/(wp-login|wp-admin)\b", ["wp"]),
    ("block", r"/cgi-bin/", ["cgi", "bin"]),
    ("block", r"[?&](session_id|phpsessid)=", ["session|phpsessid"]),
    ("allow", r"://([^/?#]*\.)?adult-x\.[^/]+/en/education/", ["adult", "x", "education"]),
]
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. The rule list is folded into one expression."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def index_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """rules (rule_id, verdict, pattern, literals) with the token that fewest urls contain; null where a rule has none.

    Tokens of which a match has one at least count together, and give the rule a row each.
    """
    alternatives = rules.select("rule_id", F.explode("literals").alias("literal")).select("rule_id", "literal", F.explode(F.split("literal", "\\|")).alias("token"))
    wanted = alternatives.select("token").distinct()
    seen = urls.select(F.explode(tokens(F.col("url"))).alias("token")).join(F.broadcast(wanted) if rules.count() <= BROADCAST_RULES else wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    sums = alternatives.join(seen, "token", "left").groupBy("rule_id", "literal").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rarest = sums.groupBy("rule_id").agg(F.min_by("literal", F.struct("n", "literal")).alias("literal"))
    return rules.join(rarest, "rule_id", "left").select("rule_id", "verdict", "pattern", F.explode_outer(F.split("literal", "\\|")).alias("token"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", host_rules: list[tuple[str, str, str]] | None = None, pattern_rules: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, matched) of every row; matched: ids of the pattern rules that match."""
    spark = pages.sparkSession
    host_rules = HOST_RULES if host_rules is None else host_rules
    pattern_rules = PATTERN_RULES if pattern_rules is None else pattern_rules
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rules = spark.createDataFrame([(k, v, p, t) for k, (v, p, t) in enumerate(pattern_rules)], "rule_id int, verdict string, pattern string, literals array<string>")
    index = index_rules(rows, rules)
    small = len(pattern_rules) <= BROADCAST_RULES
    held = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    # distinct urls are judged once: this also makes repeated and null ids harmless
    times = rows.where(F.col("url").isNotNull()).groupBy("url").agg(F.count("*").alias("times"))
    urls = times.select("url")
    by_token = urls.select("url", F.explode(tokens(F.col("url"))).alias("token")).join(held(index.where(F.col("token").isNotNull()).withColumnRenamed("token", "_t")), F.col("token") == F.col("_t"))
    matched = by_token.where(F.expr("rlike(lower(url), pattern)")).select("url", "rule_id", "verdict")
    for k, (verdict, pattern, literals) in enumerate(pattern_rules):
        if not literals:  # none in the list above: such a rule runs on every url
            matched = matched.unionByName(urls.where(F.lower("url").rlike(pattern)).select("url", F.lit(k).alias("rule_id"), F.lit(verdict).alias("verdict")))
    found = matched.groupBy("url").agg(F.sort_array(F.collect_set("rule_id")).alias("matched"), F.max((F.col("verdict") == "allow").cast("int")).alias("allowed"))
    # a hot url is met by broadcast; the weights of the few matched urls say which are hot
    weighed = materialize(times.join(found, "url"), "url-matches")
    judged = spread_join(rows, weighed, "url", "times", weighed.agg(F.sum("times")).first()[0] or 0, "left")
    judged = judged.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("hit", host_rule(F.col("host"), F.col("path"), host_rules))
    by_method = F.when(F.col("matched").isNotNull() & (F.col("allowed") == 0), "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", by_method).alias("verdict"), F.coalesce("matched", F.array().cast("array<int>")).alias("matched"))
