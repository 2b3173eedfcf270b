"""gridlore: layout, kernel, cost-model and measurement analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
