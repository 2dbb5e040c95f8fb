"""Dead letters, metric points and alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tachado import constants as K
from tachado.functions.text import cut


def dead_letters(failures: DataFrame, source: str = "intake") -> DataFrame:
    """A message for every row with an error.

    ``failures`` has event, error_message, error_step, document_id, user_id and ts.
    """
    bad = failures.filter("error_message is not null")
    body = F.struct(
        F.col("event").alias("originalEvent"),
        F.struct(cut("error_message", 2048).alias("message"), F.col("error_step").alias("step"),
                 F.col("ts").alias("timestamp")).alias("error"),
        F.struct(F.col("document_id").alias("documentId"), F.col("user_id").alias("userId"),
                 F.lit(source).alias("source")).alias("metadata"))
    return bad.select("document_id", "error_step", "ts", cut("error_message", 2048).alias("message"),
                      F.to_json(body).alias("body"))


def metric_points(errors: DataFrame) -> DataFrame:
    """One count per error: of a service (with its error type, if any) or of a pipeline step.

    ``errors`` has ts, service, error_type and error_step; a row with a service is a service error.
    """
    of_service = F.col("service").isNotNull()
    dims = F.when(of_service, F.create_map(F.lit("ServiceName"), F.col("service"), F.lit("ErrorType"),
                                           F.nullif("error_type", F.lit("")))).otherwise(
        F.create_map(F.lit("ErrorStep"), F.col("error_step")))
    name = F.when(of_service, "ServiceInvocationError").otherwise("PipelineError")
    return errors.select("ts", name.alias("name"), F.map_filter(dims, lambda k, v: v.isNotNull()).alias("dims"),
                         F.lit(1.0).alias("value"), F.lit("Count").alias("unit"))


def in_window(ts, width: str = K.WINDOW) -> Column:
    return F.window(ts, width)["start"].alias("window_start")


def threshold(thresholds: dict[str, float], default: float) -> Column:
    """The threshold of a row's ``name``."""
    limit = F
    for name, value in thresholds.items():
        limit = limit.when(F.col("name") == name, float(value))
    return limit.otherwise(float(default)) if thresholds else F.lit(float(default))


def error_alarms(metrics: DataFrame, width: str = K.WINDOW, thresholds: dict[str, float] | None = None,
                 default: float = K.ERRORS_PER_WINDOW) -> DataFrame:
    """Sum per name and window, and whether it is over the name's threshold (A10).

    A window without points has no row and raises nothing.
    """
    limit = threshold(thresholds or {}, default)
    sums = metrics.groupBy(in_window("ts", width), "name").agg(F.sum("value").alias("total"))
    return sums.withColumn("breaching", F.col("total") > limit)


#: Stretches into which the values between the brackets are cut, so that ranks are summed, not counted through in one task.
STRETCHES = 1024


def latency_p99(metrics: DataFrame, width: str = K.WINDOW, q: float = 0.99, limit: float = K.LATENCY_P99_MS,
                accuracy: int = 10000) -> DataFrame:
    """Exact interpolated percentile per name and window, and whether it breaches.

    Exact without gathering a window's values, in the same way whatever their number: a sketch brackets the rank to
    within a few parts in ``accuracy``; values below and above the brackets are only counted, with the nearest of each.
    Those between are counted by value and cut into stretches, whose totals (at most a thousand rows a window) say which
    one or two hold the rank; only these are ranked.  A rank outside of the brackets is an error, not a wrong number.
    """
    keys = ["window_start", "name"]
    points = metrics.select(in_window("ts", width), "name", F.col("value").cast("double").alias("value")).filter("value is not null")
    eps = 2.0 / accuracy
    near = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        "value", [max(0.0, q - eps), min(1.0, q + eps)], accuracy).alias("side"))
    value, low, high = F.col("value"), F.col("side")[0], F.col("side")[1]
    zone = F.when(value < low, -1).when(value > high, STRETCHES).otherwise(
        F.least(F.lit(STRETCHES - 1), F.coalesce(F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * STRETCHES), F.lit(0)))).cast("int")
    at = (F.col("n") - 1) * F.lit(q)
    first, second = F.floor(at), F.ceil(at)
    # One row per value; below the brackets one for all, which stands for the largest, and above for the smallest.
    placed = points.join(near, keys).select(*keys, "n", "value", zone.alias("stretch"))
    alone = F.col("stretch").between(0, STRETCHES - 1)
    counts = placed.groupBy(*keys, "n", "stretch", F.when(alone, value).alias("v")).agg(
        F.count(F.lit(1)).alias("c"), F.max("value").alias("most"), F.min("value").alias("least"))
    counts = counts.withColumn("v", F.coalesce("v", F.when(F.col("stretch") < 0, F.col("most")).otherwise(F.col("least"))))
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "n", "stretch").agg(F.sum("c").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0)))
    holding = totals.filter((F.col("base") <= second) & (F.col("base") + F.col("t") > first)).select(*keys, "stretch", "base")
    upto = F.col("base") + F.sum("c").over(Window.partitionBy(*keys, "stretch").orderBy("v"))
    ranked = counts.join(holding, [*keys, "stretch"]).select(*keys, "n", "v", "c", "stretch", upto.alias("upto"))
    # The rows for all below and all above know only their last and first value.
    outside = ((F.col("stretch") < 0) & (first < F.col("upto") - 1)) | ((F.col("stretch") == STRETCHES) & (second > F.col("upto") - F.col("c")))
    ranked = ranked.withColumn("v", F.when(outside, F.raise_error(F.lit("the rank lies outside of the brackets")).cast("double")).otherwise(F.col("v")))
    out = ranked.groupBy(*keys, "n").agg(F.min(F.when(F.col("upto") > first, F.col("v"))).alias("lo"),
                                         F.min(F.when(F.col("upto") > second, F.col("v"))).alias("hi"))
    p = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((second - at) * F.col("lo") + (at - first) * F.col("hi"))
    return out.select(*keys, p.alias("p99")).withColumn("breaching", F.col("p99") > limit)
