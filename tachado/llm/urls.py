"""URL filters: fixed host and path rules, and rules mined from labelled URLs with FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    """Between ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; empty for null or no ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: host labels, path segments and names of query parameters."""
    def marked(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(mark), p))

    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1))
    return F.array_distinct(F.coalesce(F.concat(
        marked("host=", F.split(host(url), r"\.")), marked("path=", F.split(path(url), "/")), marked("query=", names)),
        F.array().cast("array<string>")))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.8, min_rows: int = 10) -> DataFrame:
    """Rules "these tokens, so bad" from ``labelled`` (url, bad): rule_id, items, confidence, support.

    A rule needs ``min_support`` of the labelled rows and ``min_rows`` of them at least, and ``min_confidence``; of rules
    of equal items one is kept, and a rule is pruned if one with fewer of its items is as confident.  Their number is
    bounded by the support, not by the rows.  No labelled rows: no rules.
    """
    spark = labelled.sparkSession
    baskets = labelled.where(F.col("bad").isNotNull()).select(F.concat(
        tokens(F.col("url")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], "rule_id int, items array<string>, confidence double, support double")
    least = max(min_support, min_rows / n)
    found = [] if least > 1 else (
        FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(baskets).associationRules
        .where(F.array_contains("consequent", BAD)).select(F.array_sort("antecedent").alias("items"), "confidence", "support").collect())
    kept: list = []
    for rule in sorted(found, key=lambda r: (len(r["items"]), r["items"])):
        if not any(set(k["items"]) < set(rule["items"]) and k["confidence"] >= rule["confidence"] for k in kept):
            kept.append(rule)
    return spark.createDataFrame([(i, r["items"], r["confidence"], r["support"]) for i, r in enumerate(kept)],
                                 "rule_id int, items array<string>, confidence double, support double")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` values on which some rule holds: postings of the rules' tokens, counted per URL and rule."""
    postings = rules.select("rule_id", F.size("items").alias("need"), F.explode("items").alias("token"))
    have = urls.select("url").distinct().select("url", F.explode(tokens(F.col("url"))).alias("token"))
    hits = have.join(postings, "token").groupBy("url", "rule_id", "need").agg(F.count(F.lit(1)).alias("n"))
    return hits.where(F.col("n") == F.col("need")).select("url").distinct()


def ruled(hosts: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``hosts`` (host, path) with ``rule`` and ``ruling`` of the longest fitting rule (verdict, host, path), else null.

    A rule fits its host and every subdomain if the path starts with its own; of equally long ones block wins, then the
    first in order of text.
    """
    fits = [F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(
        F.lit(h + p).alias("rule"), F.lit(verdict).alias("ruling")))
        for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))]
    nothing = F.lit(None).cast("struct<rule:string,ruling:string>")
    return hosts.withColumn("_fit", F.coalesce(*fits, nothing)).withColumns(
        {"rule": F.col("_fit.rule"), "ruling": F.col("_fit.ruling")}).drop("_fit")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], **mining) -> DataFrame:
    """A verdict for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, mined.

    ``labels`` (doc_id, quality, toxic) label the page of the same id; low quality or toxic is bad.  ``mined`` says
    whether a mined rule holds; it decides where no fixed rule fits.  Null URLs have empty host and path and are allowed.
    Repeated pages are judged each; other columns are ignored.
    """
    rows = pages.select("page_id", "url")
    bad = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    blocked = matched(rows, mine(rows.join(bad, F.col("page_id") == F.col("doc_id")).select("url", "bad"), **mining))
    rows = rows.join(blocked.withColumn("mined", F.lit(True)), "url", "left")
    rows = ruled(rows.withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "mined": F.coalesce("mined", F.lit(False))}), rules)
    return rows.select("page_id", "host", "path", "rule", F.coalesce(
        "ruling", F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
