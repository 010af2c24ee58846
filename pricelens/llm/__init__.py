"""Operators for large text corpora; nothing else in the library imports this subpackage.

Functions that run in Python workers are sent with the job, so executors need the
installed libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
