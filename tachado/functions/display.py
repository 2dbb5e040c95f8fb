"""Scalar helpers behind listings and the audit view: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tachado import constants as K
from tachado.functions.text import as_col

MB = 1048576


def fixed(x, digits: int) -> Column:
    """A number with a fixed count of decimals, halves away from zero, no grouping."""
    return F.round(as_col(x), digits).cast(f"decimal(20,{digits})").cast("string")


def human_bytes(x) -> Column:
    n = as_col(x)
    return (F.when(n.isNull(), K.NOT_AVAILABLE)
            .when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
            .when(n < MB, F.concat(fixed(n / 1024, 1), F.lit(" KB")))
            .otherwise(F.concat(fixed(n / MB, 2), F.lit(" MB"))))


def _tenths_of_second(ms: Column) -> Column:
    """Seconds with one decimal, rounded on the binary value as ``toFixed`` does.

    Under a minute a double times 2**52 is a whole number that fits a bigint, so
    the rounding can be done exactly in integers.
    """
    units = (ms / 1000 * F.lit(float(2 ** 52))).cast("bigint")
    tenths = F.call_function("div", units * F.lit(20) + F.lit(2 ** 52), F.lit(2 ** 53))
    return F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"))


def human_duration(ms) -> Column:
    n = as_col(ms)
    rest = F.floor((n % 60000) / 1000 + 0.5).cast("bigint").cast("string")
    return (F.when(n.isNull(), K.NOT_AVAILABLE)
            .when(n < 1000, F.concat(n.cast("string"), F.lit(" ms")))
            .when(n < 60000, F.concat(_tenths_of_second(n), F.lit(" s")))
            .otherwise(F.concat(F.floor(n / 60000).cast("string"), F.lit("m "), rest, F.lit("s"))))


def doc_state(status) -> Column:
    s = F.upper(F.coalesce(as_col(status), F.lit("")))
    return (F.when(s == "COMPLETED", "COMPLETED").when(s.isin("FAILED", "ERROR"), "FAILED")
            .when(s == "PROCESSING", "PROCESSING").otherwise("PENDING"))


def masked_state(status, masked_key, entities_found) -> Column:
    """State of the masked file: CREATED, CREATING, PENDING or NONE."""
    state, key = doc_state(status), F.coalesce(as_col(masked_key), F.lit(""))
    return (F.when((state == "COMPLETED") & (key == "") & F.coalesce(as_col(entities_found) == 0, F.lit(False)), "NONE")
            .when(state == "COMPLETED", "CREATED").when(state == "FAILED", "NONE")
            .when(state == "PROCESSING", "CREATING").otherwise("PENDING"))


def audit_result(status) -> Column:
    s = F.upper(F.coalesce(as_col(status), F.lit("")))
    return (F.when(s == "COMPLETED", K.RESULT_OK).when(s.isin("FAILED", "ERROR"), K.RESULT_ERROR)
            .when(s.isin("PROCESSING", "UPLOADED"), K.RESULT_RUNNING)
            .when(s == "", K.NOT_AVAILABLE).otherwise(s))


def effective_time(completed_at, uploaded_at) -> Column:
    return F.coalesce(as_col(completed_at), as_col(uploaded_at))


def lookup(x, table: dict, default) -> Column:
    """Look a value up in a small literal table."""
    out = F
    for key, value in table.items():
        out = out.when(as_col(x) == key, value)
    return out.otherwise(default) if table else default


def severity_label(x) -> Column:
    other = F.coalesce(F.nullif(as_col(x), F.lit("")), F.lit(K.NOT_AVAILABLE))
    return lookup(x, K.SEVERITY_LABELS, other)


def clamp01(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), as_col(x).cast("double")))


def compact_number(x) -> Column:
    """A decimal as JSON writes it: an integer if it is whole, else a float."""
    n = as_col(x)
    return F.when(n % 1 == 0, n.cast("bigint").cast("string")).otherwise(n.cast("double").cast("string"))
