"""Operators for preparing training data for language models, and the queries that apply them to whole tables.

Functions of this package that run inside tasks travel to the executors by value, so executors need
no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
