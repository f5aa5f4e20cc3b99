"""Operators for large training-data pipelines; nothing else in the library imports them.

The package is pickled by value, so executors need only the third-party
libraries and not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
