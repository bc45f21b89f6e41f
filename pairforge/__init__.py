"""Spark operators that score, pair, augment, evaluate and audit text data."""

import sys

from pyspark import cloudpickle

# Ship the helper functions with each task, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
