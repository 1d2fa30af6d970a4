"""Operators for preparing training text. Nothing else in the library imports this folder.

Functions that run in Python workers travel by value, so that a cluster whose workers
lack the package can run them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
