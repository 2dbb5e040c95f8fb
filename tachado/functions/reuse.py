"""Building a long expression once per session.

A column built from nested lambdas takes thousands of calls to the JVM; the object
itself is immutable and can stand in any number of plans.
"""

from __future__ import annotations

import functools
from typing import Callable

from pyspark import SparkContext
from pyspark.sql import Column


def once_per_session(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep what ``build`` returns for the same plain arguments while the session lasts."""
    @functools.wraps(build)
    def wrapped(*args, **kwargs) -> Column:
        sc = SparkContext._active_spark_context
        plain = all(isinstance(a, (str, int, float, bool, type(None))) for a in (*args, *kwargs.values()))
        if sc is None or not plain:
            return build(*args, **kwargs)
        kept = sc.__dict__.setdefault("_tachado_columns", {})
        key = (build.__qualname__, args, tuple(sorted(kwargs.items())))
        if key not in kept:
            kept[key] = build(*args, **kwargs)
        return kept[key]
    return wrapped
