"""Operators of a training-data pipeline, one module each.

Nothing else in the library imports this subpackage; the registered queries
are in ``queries`` and their SQL in ``oracles``.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so that a
# cluster needs no copy of the library on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
