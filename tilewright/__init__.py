"""Spark-first analytics over tables of image tiles, their feature vectors and the structures built on them."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
