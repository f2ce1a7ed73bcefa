"""Exact, proof-carrying graph-colouring analytics on Spark, and training-data operators."""

import sys

from pyspark import cloudpickle

# Kernels travel with their tasks: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
