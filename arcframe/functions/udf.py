"""Arrow UDFs that need no session when their module is imported."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF over Arrow batches, made at each use. The function's hints give its kind."""

    def decorate(function: Callable) -> Callable[..., Column]:
        @wraps(function)
        def call(*columns: Column) -> Column:
            return F.pandas_udf(function, returns)(*columns)

        return call

    return decorate
