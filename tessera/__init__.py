"""Retrieval, evaluation and corpus-preparation jobs for Apache Spark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so the library needs no installation there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
