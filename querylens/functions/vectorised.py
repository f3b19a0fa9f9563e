"""Vectorised functions that need no session until they are used, so their modules can be imported anywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F


def vectorised(ddl: str) -> Callable:
    """Like pandas_udf with a type in words; func is the plain function."""

    def wrap(func: Callable) -> Callable:
        def call(*columns):
            return F.pandas_udf(func, ddl)(*columns)

        call.func, call.__doc__, call.__name__ = func, func.__doc__, func.__name__
        return call

    return wrap
