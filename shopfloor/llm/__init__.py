"""Operators of a training-data pipeline over document and embedding tables.

Functions of this subpackage that run on executors are shipped by value, so
that a cluster needs no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
