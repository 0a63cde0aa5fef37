"""Operators for training-data pipelines over whole document tables."""

import sys

from pyspark import cloudpickle

# workers need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
