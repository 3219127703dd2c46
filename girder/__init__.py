"""girder: a PySpark-native engine for curating and measuring annotation and text corpora."""

import sys

from pyspark import cloudpickle

# Executors may start without this package on their path: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
