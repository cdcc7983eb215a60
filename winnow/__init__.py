"""Spark-native analytics and compaction of conversation transcripts."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value: executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
