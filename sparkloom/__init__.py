"""sparkloom: a PySpark-native analytics engine built on DataFrames, Spark SQL and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
