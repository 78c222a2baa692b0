"""Operators of a large-scale training-data pipeline.

Functions that run inside Python tasks are shipped by value, so executors need the
libraries only, not this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
