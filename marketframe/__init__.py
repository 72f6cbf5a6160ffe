"""marketframe: keyed, time-ordered analytics as Spark jobs."""

from pyspark import cloudpickle

import sys

# Functions that run in Python workers travel with the job, so the package
# need not be installed on every executor.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
