"""Spark-native single-cell analytics: verbs over DataFrames in which a row is a cell."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
