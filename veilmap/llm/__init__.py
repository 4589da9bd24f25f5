"""Operators of training-data pipelines."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions for Python workers travel with the job, so executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
