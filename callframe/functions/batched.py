"""Arrow-batched functions that are bound to a session only when they are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(returns) -> Callable:
    """Like pandas_udf, but a module that uses it can be imported before a session exists."""

    def wrap(function: Callable) -> Callable[..., Column]:
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(function, returns)(*columns)

        call.__name__, call.__doc__, call.plain = function.__name__, function.__doc__, function
        return call

    return wrap
