"""Arrow UDFs that are made on first use, when a session exists, and whose code travels with them."""

from __future__ import annotations

import functools
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F


def arrow_udf(schema: str):
    """Like pandas_udf, but no session is needed to define one."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, schema)(*columns)

        return call

    return wrap


def ship(module: str) -> None:
    """Pickle the functions of this module by value when they go to Python workers."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
