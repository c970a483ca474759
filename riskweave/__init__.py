"""Spark-native risk signals, dataset quality and training-data operators."""

from pyspark import cloudpickle

import riskweave

# Functions sent to Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(riskweave)
