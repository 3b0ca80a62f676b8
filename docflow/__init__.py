"""Spark-native jobs over document-extraction responses and service logs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions used inside tasks travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
