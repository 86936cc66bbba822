"""Spatial and subsurface analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python workers may not have this repository on their path: ship functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
