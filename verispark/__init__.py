"""Spark-native corpus quality, guarding and governance analytics."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
