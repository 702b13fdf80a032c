"""Complex-survey epidemiology on Spark DataFrames.

Every public operator takes a DataFrame plus column names and returns a DataFrame.
"""

import sys

from pyspark import cloudpickle

# The few Arrow helpers are shipped with their tasks, so executors need no install of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
