"""Tessera: typed graph + vector retrieval on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# UDF code travels with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
