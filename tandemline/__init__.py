"""Spark-native analytics for two-channel timelines."""

import sys

from pyspark import cloudpickle

# functions of this package travel with the tasks that call them, so that executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
