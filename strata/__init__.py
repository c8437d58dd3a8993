"""Strata: fusion of survey grids, target ranking and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
