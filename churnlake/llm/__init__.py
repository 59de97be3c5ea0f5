"""Operators for preparing training data: ten operators, one module each.

Nothing else in the library imports this subpackage. ``catalog`` holds the
queries and their DuckDB twins. Functions that run in Spark's Python workers
are shipped by value, so executors need not have the package installed."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
