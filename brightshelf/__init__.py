"""Spark-native catalog search and behaviour analytics."""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel with their jobs, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
