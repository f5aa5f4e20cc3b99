"""Event histories to typed ledgers, on Spark.

The package is pickled by value, so executors need only the third-party libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
