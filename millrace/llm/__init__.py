"""Operators for training-data pipelines over documents, pages and conversations.

Nothing else in the library imports this subpackage.  Functions that run on
executors are pickled by value, so that a cluster needs no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
