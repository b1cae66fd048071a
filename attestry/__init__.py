"""Evidence analytics over code corpora, recorded calls and machine-written specifications, on Spark."""

import sys

from pyspark import cloudpickle

# Task functions travel whole to the executors, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
