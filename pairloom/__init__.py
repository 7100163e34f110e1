"""pairloom: Spark jobs that clean, featurise, match and review text at scale."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
