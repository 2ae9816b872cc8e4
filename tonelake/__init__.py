"""Symbolic-music analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value: none of them needs
# the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
