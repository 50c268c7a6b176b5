"""PySpark-native engine for longitudinal clinical records.

Operators are plain ``DataFrame -> DataFrame`` functions; nothing in the data
path collects rows to the driver, and every order-sensitive operator takes an
explicit total order.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
