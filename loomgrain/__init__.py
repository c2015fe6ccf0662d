"""Corpus building, retrieval and text analytics as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the plan: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
