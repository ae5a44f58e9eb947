"""Quadrille: mesh analytics and corpus operators on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
