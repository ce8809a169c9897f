"""Operators of a training-data pipeline; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Python code travels with the plan: workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
