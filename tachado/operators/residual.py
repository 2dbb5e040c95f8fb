"""What is left after masking, and what scanners found."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tachado import constants as K
from tachado.functions.arrays import bound, sums_before
from tachado.functions.display import severity_label
from tachado.functions.text import as_col
from tachado.operators.detect import page_candidates
from tachado.operators.mask import label
from tachado.operators.overlap import explode_entities

DISABLED, REQUESTED, UNAVAILABLE = "DISABLED", "REQUESTED", "UNAVAILABLE"


def label_spans(entities, labels: dict | None = None) -> Column:
    """Where the labels of settled entities lie in the masked text, as an array of (s, e)."""
    each = F.transform(as_col(entities), lambda e: F.struct(
        e["start_offset"].alias("at"), F.length(label(e["type"], e["source"], labels)).alias("n"), (e["end_offset"] - e["start_offset"]).alias("was")))
    return bound(each, lambda xs: F.zip_with(xs, sums_before(F.transform(xs, lambda x: x["n"] - x["was"])), lambda x, moved: F.struct(
        (x["at"] + moved).alias("s"), (x["at"] + moved + x["n"]).alias("e"))))


def residual_scan(masked_pages: DataFrame, rules: Iterable | None = None, labels: dict | None = None) -> DataFrame:
    """Personal data that still matches on masked text.

    ``masked_pages`` comes from ``mask_pages``: ``entities`` says where labels were put, and only hits inside one of
    those go; brackets that were in the text before are searched like the rest.
    """
    found = page_candidates(masked_pages.withColumn("text", F.col("masked_text")), rules)
    hits = found.withColumn("_labels", F.when((F.size("candidates") > 0) & (F.size("entities") > 0), label_spans("entities", labels)))
    kept = F.filter("candidates", lambda c: ~F.exists(
        F.coalesce("_labels", F.array().cast("array<struct<s:int,e:int>>")), lambda p: (c["start_offset"] >= p["s"]) & (c["end_offset"] <= p["e"])))
    return explode_entities(hits.withColumn("candidates", kept), "candidates")


def scan_status(docs: DataFrame, enabled: DataFrame, available: bool = True) -> DataFrame:
    """Per document whether its residual scan was asked for and could run."""
    wanted = enabled.select("user_id", F.lit(True).alias("_on")).distinct()
    state = F.when(F.col("_on").isNull(), DISABLED).otherwise(REQUESTED if available else UNAVAILABLE)
    return docs.join(wanted, "user_id", "left").withColumn("scan_status", state).drop("_on")


def scan_scopes(originals: DataFrame, masked: DataFrame, rules: Iterable | None = None) -> DataFrame:
    """Hits by scope and type, before and after masking."""
    before = page_candidates(originals, rules)
    before = explode_entities(before, "candidates").select(F.lit(K.SCOPES[K.ROOT_ORIGINALS]).alias("scope"), "type")
    after = residual_scan(masked, rules).select(F.lit(K.SCOPES[K.ROOT_MASKED]).alias("scope"), "type")
    return before.unionByName(after).groupBy("scope", "type").agg(F.count(F.lit(1)).alias("findings"))


def scan_jobs(requests: DataFrame) -> DataFrame:
    """Two scans per user, one per scope, with how many could be started.

    ``requests`` has user_id and whether each scope's scan started, as map<scope, boolean>.
    """
    jobs = requests.select("user_id", "started", F.explode(F.array(*[
        F.struct(F.lit(root).alias("root"), F.lit(scope).alias("scope")) for root, scope in K.SCOPES.items()])).alias("s"))
    state = F.when(F.coalesce(F.try_element_at("started", F.col("s.scope")), F.lit(False)), "CREATED").otherwise("FAILED")
    return jobs.select("user_id", F.col("s.scope").alias("scope"),
                       F.concat(F.col("s.root"), F.lit("/"), "user_id", F.lit("/")).alias("prefix"), state.alias("status"))


def finding_scope(key, user) -> Column:
    """ORIGINALES or OFUSCADOS for the user's own keys, null for others."""
    out = F
    for root, scope in K.SCOPES.items():
        out = out.when(F.startswith(key, F.concat(F.lit(f"{root}/"), user, F.lit("/"))), scope)
    return out


def scope_findings(findings: DataFrame, user, bucket: str | None = None) -> DataFrame:
    """Findings on a user's originals or masked files, scope and severity spelled out.

    A finding without a bucket is taken to be in this one.
    """
    u = F.lit(user) if isinstance(user, str) else user
    mine = findings.withColumn("scope", finding_scope(F.col("key"), u)).filter("scope is not null")
    if bucket is not None:
        mine = mine.filter((F.coalesce("bucket", F.lit("")) == "") | (F.col("bucket") == bucket))
    return mine.withColumn("severity", severity_label("severity"))


def top_findings(findings: DataFrame, n: int = K.TOP_FINDINGS, user=None, bucket: str | None = None,
                 category: str = "CLASSIFICATION") -> DataFrame:
    """The newest ``n`` findings of a category, of the user's if one is named (T5)."""
    of_kind = findings.filter(F.col("category") == category)
    mine = of_kind if user is None else scope_findings(of_kind, user, bucket)
    return mine.orderBy(F.col("updated_at").desc(), F.col("id")).limit(n)


def finding_summary(findings: DataFrame) -> DataFrame:
    """How many findings there are and whether any."""
    n = F.count(F.lit(1))
    return findings.agg(n.alias("findings"), (n > 0).alias("residual"))
