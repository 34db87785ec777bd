"""Readers of rating sets and writers of results; functions that run in Python workers travel by value."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
