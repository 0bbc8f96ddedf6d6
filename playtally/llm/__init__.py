"""Operators for preparing training data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value: a cluster's
# executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
