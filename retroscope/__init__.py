"""Decision-outcome text analytics as composable Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry this package's code with them, so workers need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
