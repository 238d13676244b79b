"""Ordered-data toolkit for PySpark.

Sparse CSV, expand and delta-encode, range and row-number lookups, repeatable
sampling, time series downsampling, and bulk import of binary recordings.
"""

import sys

from pyspark import cloudpickle

# functions sent to executors travel by value: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
