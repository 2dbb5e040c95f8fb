"""Per-user detection settings.

A configuration table grows with the users, so nothing here is broadcast by hint:
joins carry a user's one row to that user's documents, the engine broadcasts it
when it is small and splits a user with very many documents when it is not.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tachado import constants as K
from tachado.functions import patterns
from tachado.functions.text import is_blank
from tachado.schemas import CONFIG_FIELDS
from tachado.sources import buckets

_RULES = "array<struct<type:string,pattern:string,enabled:boolean>>"


def default_values() -> dict[str, Column]:
    """Every setting's default, by column name."""
    rules = F.array(*[F.struct(F.lit(t).alias("type"), F.lit(p).alias("pattern"), F.lit(e).alias("enabled"))
                      for t, p, e in K.DEFAULT_RULES])
    return {
        "method": F.lit(K.DEFAULT_METHOD), "residual_scan": F.lit(K.DEFAULT_RESIDUAL_SCAN),
        "alerts": F.lit(K.DEFAULT_ALERTS), "model_id": F.lit(K.DEFAULT_MODEL_ID),
        "temperature": F.lit(K.DEFAULT_TEMPERATURE), "prompt": F.lit(K.DEFAULT_PROMPT),
        "rules": rules.cast(_RULES), "ignored": F.array().cast("array<string>"),
    }


def default_config(users: DataFrame) -> DataFrame:
    """A full default configuration for each user."""
    return users.select("user_id", *[c.alias(n) for n, c in default_values().items()])


def resolve_config(users: DataFrame, config: DataFrame) -> DataFrame:
    """Each user's settings, field by field from the stored row or the defaults.

    A user without a row, or a row without a field, gets the default.
    """
    stored = [c for c in config.columns if c != "user_id"]
    joined = users.select("user_id").join(config, "user_id", "left")
    return joined.select("user_id", *[
        (F.coalesce(F.col(n), d) if n in stored else d).alias(n) for n, d in default_values().items()])


def with_config(docs: DataFrame, config: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Documents with their user's settings, defaults where there are none."""
    defaults = default_values()
    fields = fields or list(defaults)
    stored = config.select("user_id", *[c for c in fields if c in config.columns])
    joined = docs.join(stored, "user_id", "left")
    return joined.select(*docs.columns, *[
        (F.coalesce(F.col(n), defaults[n]) if n in stored.columns else defaults[n]).alias(n) for n in fields])


@pandas_udf(T.ArrayType(T.BooleanType()))
def _compile_flags(rules: pd.Series) -> pd.Series:
    """Which patterns of each rule list compile."""
    return rules.map(lambda rs: [bool(r["pattern"]) and patterns.compiles(r["pattern"]) for r in rs])


def validate_config(config: DataFrame) -> DataFrame:
    """``valid`` and ``message`` per configuration row: the first problem found.

    Takes rows as submitted: a flag or temperature that is not of its type comes
    as text in ``residual_scan``, ``alerts`` or ``temperature``.  ``ignored`` and
    ``rules`` may be null (nothing submitted).
    """
    rules, ignored = F.coalesce("rules", F.array().cast(_RULES)), F.coalesce("ignored", F.array().cast("array<string>"))
    method = F.coalesce("method", F.lit(K.DEFAULT_METHOD))
    temperature = F.coalesce(F.col("temperature").cast("string"), F.lit("0"))
    number = F.when(temperature.rlike(r"\A[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\z"),
                    temperature.try_cast("double"))

    def flag(name):
        return ~F.coalesce(F.col(name).cast("string"), F.lit("true")).isin("true", "false")

    def rule_problem(z):
        """The first problem of one rule, in the order a rule is looked at."""
        r = z["r"]
        return (F.when(is_blank(r["type"]), "rule_without_type").when(is_blank(r["pattern"]), "rule_without_pattern")
                .when(F.length(r["pattern"]) > K.MAX_PATTERN_CHARS, "pattern_too_long")
                .when(~z["compiles"], "pattern_does_not_compile"))

    checked = config.withColumn("_compiles", _compile_flags(rules))
    looked_at = F.arrays_zip(rules.alias("r"), F.col("_compiles").alias("compiles"))
    first_rule_problem = F.get(F.filter(F.transform(looked_at, rule_problem), lambda p: p.isNotNull()), F.lit(0))
    message = (
        F.when(~method.isin(K.METHODS), "unknown_method")
        .when(flag("residual_scan"), "residual_scan_not_boolean")
        .when(flag("alerts"), "alerts_not_boolean")
        .when(is_blank("model_id"), "model_missing")
        .when(number.isNull(), "temperature_not_a_number")
        .when((number < 0) | (number > 1), "temperature_out_of_range")
        .when(is_blank("prompt"), "prompt_blank")
        .when(F.length("prompt") > K.MAX_PROMPT_CHARS, "prompt_too_long")
        .when(~F.col("prompt").contains(K.PROMPT_SLOT), "prompt_without_slot")
        .when(F.size(rules) > K.MAX_RULES, "too_many_rules")
        .when(first_rule_problem.isNotNull(), first_rule_problem)
        .when(method.isin("regex", "both") & ~F.exists(rules, lambda r: F.coalesce(r["enabled"], F.lit(True))), "no_active_rule")
        .when(F.size(ignored) > K.MAX_IGNORED, "too_many_ignored")
        .when(F.exists(ignored, lambda v: v.isNull()), "ignored_not_text")
        .when(F.exists(ignored, lambda v: F.length(v) > K.MAX_IGNORED_CHARS), "ignored_too_long"))
    return (checked.withColumn("message", F.coalesce(message, F.lit("")))
            .withColumn("valid", F.col("message") == "").drop("_compiles"))


def save_config(config: DataFrame, path: str, buckets_of: int = buckets.BUCKETS) -> None:
    """Put the valid rows of a submitted configuration into the stored table, one row per user.

    What a user had stored before is replaced whole; others' rows, and the files of buckets without a submitted user,
    stay as they are.  Of several rows of one user in one call the last by its values counts.
    """
    valid = validate_config(config).filter("valid")
    full = [(F.col(f) if f in config.columns else F.lit(None)).cast(kind).alias(f) for f, kind in CONFIG_FIELDS.items()]
    buckets.upsert(valid.select(*full, F.current_timestamp().alias("updated_at")), path, ["user_id"],
                   buckets.newest(["user_id"], ["updated_at"]), buckets_of)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The stored configurations, the current row of each user."""
    return buckets.read(spark, path)


def add_rule(config: DataFrame, entity_type: str, pattern: str, enabled: bool = True) -> DataFrame:
    """Append a rule to each configuration unless it has that type and pattern already."""
    rules = F.coalesce("rules", F.array().cast(_RULES))
    there = F.exists(rules, lambda r: (r["type"] == entity_type) & (r["pattern"] == pattern))
    rule = F.struct(F.lit(entity_type).alias("type"), F.lit(pattern).alias("pattern"), F.lit(enabled).alias("enabled"))
    return config.withColumn("rules", F.when(there, rules).otherwise(F.concat(rules, F.array(rule))).cast(_RULES))


def add_prompt_line(config: DataFrame, line: str, token: str, marker: str = K.PROMPT_SECTION) -> DataFrame:
    """Put a line before the first marker, or at the end, unless the prompt has the token."""
    prompt = F.coalesce("prompt", F.lit(""))
    at = F.instr(prompt, F.lit(marker))
    inserted = F.concat(F.substr(prompt, F.lit(1), at - 1), F.lit(f"{line}\n\n"), F.substr(prompt, at))
    return config.withColumn("prompt", F.when(prompt.contains(token), prompt).when(at > 0, inserted)
                             .otherwise(F.concat(prompt, F.lit(f"\n\n{line}"))))


def residual_enabled(config: DataFrame) -> DataFrame:
    """Users who asked for a scan of their masked output; off unless it is on."""
    return config.filter(F.coalesce("residual_scan", F.lit(False))).select("user_id")
