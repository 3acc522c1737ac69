"""nightloom: a Spark-first engine for analysing frames of pixels, and tables around them."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
