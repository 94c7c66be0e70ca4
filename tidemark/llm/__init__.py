"""Operators for training-data pipelines over document tables.

Nothing else in the package imports this folder. Task functions are pickled by value, so executors need
no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
