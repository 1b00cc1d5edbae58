"""Market-series analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# helpers that run inside Python workers travel with the job, nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
