"""Lodestore: analytics over a versioned, permission-scoped document corpus, on PySpark."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
