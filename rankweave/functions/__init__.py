"""Column expressions and small helpers shared by the operators; those that run in Python workers travel by value."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
