"""URL filters: given rules by host and path, and association rules mined from labelled pages.

Spark's FP-growth mines combinations of URL tokens over labelled pages; combinations that imply a
bad label with enough confidence and support are rules. A rule is indexed under its rarest
token; a URL meets the rules of its tokens by an equality join and must hold all tokens of one.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import stored

BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels with their place from the right, path parts, query names, ending.

    The scheme and host are lower-cased. Digits become ``0``, so numbered pages share tokens. Null: no token.
    """
    host = F.reverse(F.split(host_of(url), r"\."))
    plain = lambda c: F.regexp_replace(F.lower(c), r"\d+", "0")
    labels = F.transform(host, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), plain(x)))
    parts = F.transform(F.split(path_of(url), "/"), lambda x: F.concat(F.lit("path:"), plain(x)))
    names = F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.concat(F.lit("query:"), plain(F.substring_index(x, "=", 1))))
    ending = F.array(F.concat(F.lit("ending:"), F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]+)$", 1)), F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    found = F.filter(F.concat(labels, parts, names, ending), lambda x: ~F.endswith(x, F.lit(":")))
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def _baskets(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, items, bad): the tokens of each labelled page; row numbers the pages."""
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    return pages.select("page_id", "url").join(bad, "page_id").select(F.monotonically_increasing_id().alias("row"), url_tokens(F.col("url")).alias("items"), "bad").where(F.size("items") > 0)


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_count: int = 5, error: float = 0.01) -> DataFrame:
    """(rule, anchor, tokens, confidence, support): token sets that imply a bad label.

    pages: page_id, url; labels: doc_id, quality, toxic, joined on page_id = doc_id. Bad: toxic
    is 1 or quality is 0; a page with several labels is bad if one is. Null ids join nothing;
    null labels are not bad; repeated pages count as often as they occur. Support counts pages
    with the tokens and the label: a share of min_support and min_count pages at least. A rule
    also has to be beyond chance: if its pages were bad at the rate of all pages, a confidence as
    high would have to be rarer than ``error`` over all token sets tried (Chernoff's bound). A
    set that holds a smaller rule is dropped, as it decides nothing more. Tokens that occur in
    the same pages throughout are mined as one, and a rule asks for all of them, so mining
    doesn't list their combinations. No labelled page, or labels that don't follow the urls: no
    rules. Columns besides those named are left out.
    """
    spark = pages.sparkSession
    baskets = stored(_baskets(pages, labels), "baskets")
    n, n_bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    empty = "rule long, anchor string, tokens array<string>, confidence double, support double"
    if not n_bad:
        return spark.createDataFrame([], empty)
    least = max(min_support, min_count / n)
    if least > n_bad / n:
        return spark.createDataFrame([], empty)
    # tokens of equal pages: their count and two sums of page hashes agree
    held = baskets.select(F.xxhash64("row").alias("h"), F.explode("items").alias("token"))
    wrap = lambda c: F.sum(F.pmod(c, F.lit(1 << 31)))
    per = held.groupBy("token").agg(F.count("*").alias("freq"), wrap(F.col("h")).alias("a"), wrap(F.shiftright("h", 31)).alias("b")).where(F.col("freq") >= least * n)
    alike = Window.partitionBy("freq", "a", "b")
    per = stored(per.select("token", "freq", F.min("token").over(alike).alias("first"), F.collect_set("token").over(alike).alias("alike")), "tokens")
    firsts = per.where("token = first").select("token")
    kept = baskets.select("row", F.explode("items").alias("token")).join(firsts, "token").groupBy("row").agg(F.collect_set("token").alias("found"))
    nothing = F.array().cast("array<string>")
    all_rows = baskets.select("row", "bad").join(kept, "row", "left").select(F.concat(F.coalesce("found", nothing), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(nothing)).alias("items"))
    mined = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(stored(all_rows, "mined"))
    tried = mined.freqItemsets.where(~F.array_contains("items", BAD)).count()
    base, c = n_bad / n, F.col("confidence")
    if base == 1:
        return spark.createDataFrame([], empty)
    # Chernoff: so many bad pages among those that hold the set are rarer than exp(-pages * apart)
    apart = c * F.ln(c / base) + F.when(c < 1, (1 - c) * F.ln((1 - c) / (1 - base))).otherwise(0.0)
    beyond = (c > base) & (F.col("support") * n / c * apart >= math.log(max(1, tried) / error))
    rules = mined.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).where(beyond).select("antecedent", "confidence", "support")
    rules = stored(rules.select(F.monotonically_increasing_id().alias("rule"), "*"), "rules")
    full = rules.select("rule", F.explode("antecedent").alias("token")).join(per, "token").groupBy("rule").agg(F.array_sort(F.flatten(F.collect_list("alike"))).alias("tokens"), F.min(F.struct("freq", "token"))["token"].alias("anchor"))
    rules = stored(rules.select("rule", "confidence", "support").join(full, "rule"), "anchored")
    # a rule within another lies under one of that other's tokens
    larger = rules.select(F.col("rule").alias("big"), F.col("tokens").alias("big_tokens"), F.explode("tokens").alias("anchor"))
    within = larger.join(rules.select("anchor", "tokens"), "anchor").where((F.size("tokens") < F.size("big_tokens")) & (F.size(F.array_except("tokens", "big_tokens")) == 0))
    return stored(rules.join(within.select(F.col("big").alias("rule")).distinct(), "rule", "left_anti").select("rule", "anchor", "tokens", "confidence", "support"), "kept")


def precision(pages: DataFrame, labels: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: n_matched labelled pages, the share of bad ones among them, and among all; for rules mined on other labels."""
    own = stored(_baskets(pages, labels), "judged_pages")
    hit = own.select("row", "items", F.explode("items").alias("anchor")).join(rules.select("anchor", "tokens"), "anchor").where(F.size(F.array_except("tokens", "items")) == 0).select("row").distinct().withColumn("hit", F.lit(1))
    bad = F.col("bad").cast("double")
    return own.join(hit, "row", "left").agg(F.count("hit").alias("n_matched"), F.avg(F.when(F.col("hit") == 1, bad)).alias("bad_share"), F.avg(bad).alias("base_share"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, n_rules, confidence): urls (distinct) that hold all tokens of a rule, with the best confidence."""
    held = urls.select("url", url_tokens(F.col("url")).alias("own")).select("url", "own", F.explode("own").alias("anchor"))
    hit = held.join(rules.select("anchor", "tokens", "confidence"), "anchor").where(F.size(F.array_except("tokens", "own")) == 0)
    return hit.groupBy("url").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))


def given_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule, verdict): the longest of the given rules (host, path, verdict) that fits, for urls that one fits.

    A rule fits its host and all subdomains if the url's path starts with the rule's. Hosts are
    matched by an equality join over a host's own suffixes. Ties: the longer host.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host <> ''")
    fits = parts.select("url", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host")).join(
        rules.select(F.lower("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict"), "rule_host"
    ).where(F.startswith("path", "rule_path"))
    name = F.concat("rule_host", "rule_path")
    best = fits.groupBy("url").agg(F.max(F.struct(F.length(name).alias("n"), F.length("rule_host").alias("m"), name.alias("rule"), "verdict")).alias("b"))
    return best.select("url", "b.rule", "b.verdict")


def judge(pages: DataFrame, labels: DataFrame, rules: DataFrame, **mining) -> DataFrame:
    """(page_id, host, path, rule, n_rules, verdict), one row for each row of pages.

    verdict: the given rule's; without one, ``block`` if a mined rule matches, else ``allow``.
    rule: host and path of the given rule, null without one. Null url or one without ``://``:
    empty host and path, and no given rule. Very long urls are judged whole; repeated pages get
    equal rows; null ids stay. Empty tables: no rows, or no rules. Columns besides those named
    are left out, so names can't clash. Every step works on distinct urls, so a common url
    or host costs once; each page then takes its url's verdict.
    """
    mined = mine_rules(pages, labels, **mining)
    urls = stored(pages.select("url").where("url is not null").distinct(), "urls")
    given, match = given_rules(urls, rules), match_rules(urls, mined)
    found = stored(urls.join(given, "url", "left").join(match, "url", "left").select(F.col("url").alias("_url"), "rule", "verdict", "n_rules").where("rule is not null or n_rules is not null"), "judged")
    default = F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    return pages.select("page_id", "url").join(found, F.col("url") == F.col("_url"), "left").select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), F.coalesce("verdict", default).alias("verdict")
    )
