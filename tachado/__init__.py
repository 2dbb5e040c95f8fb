"""Find and mask personal data in large document collections with Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel whole, so executors need no install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
